"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from salescope.llm import sql
from salescope.llm.common import table
from salescope.llm.conversation_repair import conversation_repair
from salescope.llm.decontaminate import contamination
from salescope.llm.license_scan import license_scan
from salescope.llm.line_spread import line_dedup
from salescope.llm.mixing import source_mix
from salescope.llm.nn_descent import nearest
from salescope.llm.order_minhash import near_duplicates
from salescope.llm.packing import packed_pieces
from salescope.llm.periodic_runs import run_report
from salescope.llm.quality import quality_scores
from salescope.llm.token_frames import token_files
from salescope.llm.toxicity import toxicity_scores
from salescope.llm.warc import warc_round_trip

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": lambda s, d: warc_round_trip(table(s, d, "pages")),
        "op2_quality": lambda s, d: quality_scores(table(s, d, "documents"), table(s, d, "labels")),
        "op3_near_dedup": lambda s, d: near_duplicates(table(s, d, "documents")),
        "op4_neighbours": lambda s, d: nearest(table(s, d, "embeddings")),
        "op5_line_dedup": lambda s, d: line_dedup(table(s, d, "documents")),
        "op6_toxicity": lambda s, d: toxicity_scores(table(s, d, "documents"), table(s, d, "labels")),
        "op7_decontaminate": lambda s, d: contamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_packing": lambda s, d: packed_pieces(table(s, d, "documents"), TOKENIZER),
        "op9_license": lambda s, d: license_scan(table(s, d, "documents")),
        "op10_token_files": lambda s, d: token_files(table(s, d, "documents"), TOKENIZER),
        "op11_source_mix": lambda s, d: source_mix(table(s, d, "documents")),
        "op12_periodic_runs": lambda s, d: run_report(table(s, d, "documents")),
        "op13_conversation_repair": lambda s, d: conversation_repair(table(s, d, "conversations")),
    }


def all_sql() -> dict[str, str]:
    return sql.all_sql()
