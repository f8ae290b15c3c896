"""Operators for training data at scale. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.llm.clusters import OP11_SQL, op11_clusters
from docmill.llm.divergence import OP12_SQL, op12_divergence
from docmill.llm.fingerprints import op8_fingerprints
from docmill.llm.language import op3_language
from docmill.llm.lines import op5_lines
from docmill.llm.mixing import OP6_SQL, op6_mixing
from docmill.llm.near import op9_near
from docmill.llm.packing import op1_packing
from docmill.llm.private import op4_private
from docmill.llm.repeats import op10_repeats
from docmill.llm.token_files import op2_token_files
from docmill.llm.topk import OP7_SQL, op7_topk
from docmill.llm.warc import OP13_SQL, op13_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_token_files, op3_language, op4_private, op5_lines, op6_mixing, op7_topk, op8_fingerprints, op9_near, op10_repeats]
    found += [op11_clusters, op12_divergence, op13_warc]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op7_topk": OP7_SQL, "op11_clusters": OP11_SQL, "op12_divergence": OP12_SQL, "op13_warc": OP13_SQL}
