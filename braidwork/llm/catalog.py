"""The registered queries of the corpus operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from braidwork.llm import bpe, fmindex, hnsw, langid, licences, lines, merkle, minhash, mixing, pii, quality, topk, whitening

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_pii": pii.op2_pii,
    "op3_quality": quality.op3_quality,
    "op4_minhash": minhash.op4_minhash,
    "op5_topk": topk.op5_topk,
    "op6_hnsw": hnsw.op6_hnsw,
    "op7_licences": licences.op7_licences,
    "op8_lines": lines.op8_lines,
    "op9_mix": mixing.op9_mix,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle": merkle.op11_merkle,
    "op12_fmindex": fmindex.op12_fmindex,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {
    "op4_minhash": minhash.ORACLE,
    "op5_topk": topk.ORACLE,
    "op6_hnsw": hnsw.ORACLE,
    "op8_lines": lines.ORACLE,
    "op9_mix": mixing.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_fmindex": fmindex.ORACLE,
}
