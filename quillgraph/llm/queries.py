"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.ann import op1_hnsw
from quillgraph.llm.decontaminate import op2_decontamination
from quillgraph.llm.htmltext import op4_html_extraction
from quillgraph.llm.langid import op3_language_id
from quillgraph.llm.lm import op7_lm_score
from quillgraph.llm.mixing import op6_pfair_mix
from quillgraph.llm.neardup import op10_ngram_jaccard_join
from quillgraph.llm.sharding import op8_balanced_shards
from quillgraph.llm.pii import op5_pii_surrogates
from quillgraph.llm.secrets import op9_secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw": op1_hnsw,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op6_pfair_mix": op6_pfair_mix,
    "op4_html_extraction": op4_html_extraction,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op7_lm_score": op7_lm_score,
    "op8_balanced_shards": op8_balanced_shards,
    "op9_secret_scan": op9_secret_scan,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

SQL: dict[str, str] = {}
