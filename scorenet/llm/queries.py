"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from scorenet.llm import chat_format, conversation_repair, embedding_dedup, exact_dedup
from scorenet.llm.chat_format import op4_chat_format
from scorenet.llm.conversation_repair import op13_conversation_repair
from scorenet.llm.embedding_dedup import op8_embedding_dedup
from scorenet.llm.exact_dedup import op1_exact_dedup
from scorenet.llm.hpylm import op2_hpylm
from scorenet.llm.html_content import op10_html_text
from scorenet.llm.kn_quality import op5_kn_quality
from scorenet.llm.packing import op9_packing
from scorenet.llm.piece_sampling import op6_piece_sampling
from scorenet.llm.simhash_index import op7_simhash
from scorenet.llm.stable_search import op11_stable_search
from scorenet.llm.token_frames import op3_token_frames
from scorenet.llm.whitening import op12_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_hpylm, op3_token_frames, op4_chat_format, op5_kn_quality, op6_piece_sampling,
        op7_simhash, op8_embedding_dedup, op9_packing, op10_html_text, op11_stable_search, op12_whitening, op13_conversation_repair,
    )
}

ORACLES = {**exact_dedup.ORACLE, **chat_format.ORACLE, **embedding_dedup.ORACLE, **conversation_repair.ORACLE}
