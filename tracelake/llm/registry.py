"""The queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from tracelake.llm import bpe, chat, fim, maxent, mixing, rabitq, simhash, suffixdedup, tokenfile, topk, toxicity, urlrules, whitening

QUERIES = {
    "op1_rabitq": rabitq.op1_rabitq,
    "op2_bpe": bpe.op2_bpe,
    "op3_urlrules": urlrules.op3_urlrules,
    "op4_chat": chat.op4_chat,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_maxent": maxent.op8_maxent,
    "op9_topk": topk.op9_topk,
    "op10_suffixdedup": suffixdedup.op10_suffixdedup,
    "op11_fim": fim.op11_fim,
    "op12_tokenfile": tokenfile.op12_tokenfile,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_rabitq": rabitq.OP1_SQL,
    "op3_urlrules": urlrules.OP3_SQL,
    "op4_chat": chat.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_fim": fim.OP11_SQL,
}
