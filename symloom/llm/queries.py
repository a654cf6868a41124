"""The corpus queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.llm.ann import op4_nearest_neighbours
from symloom.llm.decontaminate import OP8_SQL, op8_decontamination
from symloom.llm.langid import op3_language_id
from symloom.llm.licenses import op5_licenses
from symloom.llm.oracles import OP9_SQL, OP10_SQL
from symloom.llm.packing import op2_best_fit_packing
from symloom.llm.pii import op9_pii
from symloom.llm.quality import op7_quality
from symloom.llm.secrets import op10_secrets
from symloom.llm.simhash import op1_simhash_dedup
from symloom.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_best_fit_packing,
        op3_language_id,
        op4_nearest_neighbours,
        op5_licenses,
        op6_toxicity,
        op7_quality,
        op8_decontamination,
        op9_pii,
        op10_secrets,
    )
}

ORACLES: dict[str, str] = {"op8_decontamination": OP8_SQL, "op9_pii": OP9_SQL, "op10_secrets": OP10_SQL}
