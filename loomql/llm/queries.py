"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomql.llm.op1_simhash import op1_simhash
from loomql.llm.op10_outliers import op10_outliers
from loomql.llm.op2_resharding import op2_resharding
from loomql.llm.op3_toxicity import op3_toxicity
from loomql.llm.op4_sentencepiece import op4_sentencepiece
from loomql.llm.op5_pseudonyms import op5_pseudonyms
from loomql.llm.op6_licenses import op6_licenses
from loomql.llm.op7_mixing import ORACLE as MIXING
from loomql.llm.op7_mixing import op7_mixing
from loomql.llm.op8_transport_stream import op8_transport_stream
from loomql.llm.op9_token_files import op9_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_resharding": op2_resharding,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_transport_stream": op8_transport_stream,
    "op9_token_files": op9_token_files,
    "op10_outliers": op10_outliers,
}
ORACLES: dict[str, str] = {"op7_mixing": MIXING}
