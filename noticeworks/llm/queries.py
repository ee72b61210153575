"""The corpus queries and their SQL, as registered by the entry module."""

from __future__ import annotations

from noticeworks.llm import ballmeans, blocklstm, hnsw, langid, minhash, mixing, packing, quality, recompress, sharding, suffixes, urls, wavelet

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_vectors": hnsw.op2_vectors,
    "op3_substrings": recompress.op3_substrings,
    "op4_language": langid.op4_language,
    "op5_mix": mixing.op5_mix,
    "op6_shards": sharding.op6_shards,
    "op7_quality": quality.op7_quality,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_urls": urls.op9_urls,
    "op10_minhash": minhash.op10_minhash,
    "op11_search": wavelet.op11_search,
    "op12_pages": blocklstm.op12_pages,
    "op13_clusters": ballmeans.op13_clusters,
}

ORACLES = {
    "op5_mix": mixing.OP5_SQL,
    "op6_shards": sharding.OP6_SQL,
    "op7_quality": quality.OP7_SQL,
    "op9_urls": urls.OP9_SQL,
    "op11_search": wavelet.OP11_SQL,
    "op12_pages": blocklstm.OP12_SQL,
    "op13_clusters": ballmeans.OP13_SQL,
}
