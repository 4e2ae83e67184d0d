"""Registry of the training-data queries, one for each operator."""

from __future__ import annotations

from tidewater.llm.cotrain import op9_quality_classifier
from tidewater.llm.decontam import OP4_SQL, op4_decontamination
from tidewater.llm.hnsw import op1_embedding_near_dedup
from tidewater.llm.jaccard import op3_ngram_jaccard_join
from tidewater.llm.langid import op10_language_id
from tidewater.llm.linededup import OP2_SQL, op2_line_dedup
from tidewater.llm.pieces import op8_sentencepiece
from tidewater.llm.secrets import op5_secret_scan
from tidewater.llm.warc import OP6_SQL, op6_warc
from tidewater.llm.wrapper import op7_html_extraction

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_warc": op6_warc,
    "op7_html_extraction": op7_html_extraction,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op6_warc": OP6_SQL,
}
