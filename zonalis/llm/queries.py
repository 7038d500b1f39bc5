"""The opN queries, and their SQL where SQL can express them."""

from __future__ import annotations

from zonalis.llm.decontaminate import op9_decontaminate
from zonalis.llm.html_extract import op2_html
from zonalis.llm.language import op4_language
from zonalis.llm.media import op10_media
from zonalis.llm.pieces import op5_sentencepiece
from zonalis.llm.pii import op7_pii
from zonalis.llm.quality import op11_quality
from zonalis.llm.search import OP12_SQL, op12_search
from zonalis.llm.simhash import op8_simhash
from zonalis.llm.spelling import OP13_SQL, op13_spelling
from zonalis.llm.substrings import op3_substrings
from zonalis.llm.token_counts import op6_token_counts
from zonalis.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_html": op2_html,
    "op3_substrings": op3_substrings,
    "op4_language": op4_language,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_media": op10_media,
    "op11_quality": op11_quality,
    "op12_search": op12_search,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = {"op1_url_filter": OP1_SQL, "op12_search": OP12_SQL, "op13_spelling": OP13_SQL}
