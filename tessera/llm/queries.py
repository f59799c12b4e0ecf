"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_lloyd
from .chat import OP7_SQL, op7_chat
from .decontaminate import op4_decontamination
from .html import op5_html
from .lines import OP2_SQL, op2_linededup
from .lmscore import op10_lmscore
from .media import op6_media
from .neardup import OP3_SQL, op3_neardup
from .packing import op8_packing
from .quality import op1_quality
from .resample import OP13_SQL, op13_resample
from .urls import OP11_SQL, op11_urls
from .warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_quality, op2_linededup, op3_neardup, op4_decontamination, op5_html, op6_media, op7_chat, op8_packing, op9_warc, op10_lmscore, op11_urls, op12_lloyd, op13_resample)}

ORACLE_SQL: dict[str, str] = {"op2_linededup": OP2_SQL, "op3_neardup": OP3_SQL, "op7_chat": OP7_SQL, "op9_warc": OP9_SQL, "op11_urls": OP11_SQL, "op12_lloyd": OP12_SQL, "op13_resample": OP13_SQL}
