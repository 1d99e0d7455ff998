"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.bag_minhash import op6_bag_minhash
from tickloom.llm import decontaminate, merkle, vector_codes
from tickloom.llm.decontaminate import op1_decontaminate
from tickloom.llm.byte_bpe import op13_byte_bpe
from tickloom.llm.html_crf import op5_html_extraction
from tickloom.llm.langid import op10_language_id
from tickloom.llm.licences import op3_licences
from tickloom.llm.line_dedup import op8_line_dedup
from tickloom.llm.merkle import op12_merkle_manifest
from tickloom.llm.order_minhash import op2_order_minhash
from tickloom.llm.packing import op7_packing
from tickloom.llm.token_codec import op9_token_codec
from tickloom.llm.toxicity import op4_toxicity
from tickloom.llm.vector_codes import op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontaminate, op2_order_minhash, op3_licences, op4_toxicity, op5_html_extraction, op6_bag_minhash, op7_packing, op8_line_dedup, op9_token_codec, op10_language_id, op11_vector_codes, op12_merkle_manifest, op13_byte_bpe]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op11_vector_codes": vector_codes.ORACLE}
