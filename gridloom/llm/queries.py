"""The queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import fill_middle, lexical_search
from .decontaminate import op9_decontaminate
from .fill_middle import op11_fill_middle
from .html_text import op2_html_text
from .katz import op8_katz
from .lexical_search import op12_lexical_search
from .line_dedup import op6_line_dedup
from .ngram_join import op7_ngram_join
from .packing import op10_packing
from .repeats import op4_repeats
from .secret_scan import op13_secret_scan
from .token_frames import op1_token_frames
from .toxicity import op3_toxicity
from .transport_stream import op5_transport_stream

QUERIES = {
    "op1_token_frames": op1_token_frames,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_repeats": op4_repeats,
    "op5_transport_stream": op5_transport_stream,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_katz": op8_katz,
    "op9_decontaminate": op9_decontaminate,
    "op10_packing": op10_packing,
    "op11_fill_middle": op11_fill_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {"op11_fill_middle": fill_middle.SQL, "op12_lexical_search": lexical_search.SQL}
