"""The queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from tidepool.llm import bpe, chat, conversation_trie, decontaminate, exact_dedup, hard_negatives, html_extract, jaccard, quality, secrets, simhash, suffix_dedup, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_quality": quality.op3_quality,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_warc": warc.op9_warc,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_jaccard_join": jaccard.op11_jaccard_join,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE = {"op4_chat_formatting": chat.SQL, "op9_warc": warc.SQL, "op10_exact_dedup": exact_dedup.SQL,
          "op11_jaccard_join": jaccard.SQL, "op12_conversation_trie": conversation_trie.SQL,
          "op13_hard_negatives": hard_negatives.SQL}
