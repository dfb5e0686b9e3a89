"""The corpus operators' queries, and their SQL where SQL can express them."""

from . import bpe, decontaminate, embeddings, licenses, pii, quality, repeats, search, sharding, simhash, urlfilter, warc

QUERIES = {
    "op1_pii_disclosure": pii.op1,
    "op2_license_index": licenses.op2,
    "op3_quality_cotraining": quality.op3,
    "op4_byte_bpe": bpe.op4,
    "op5_suffix_repeats": repeats.op5,
    "op6_simhash_neardup": simhash.op6,
    "op7_url_filter": urlfilter.op7,
    "op8_warc_transactions": warc.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_embedding_caps": embeddings.op10,
    "op11_byte_shards": sharding.op11,
    "op12_ranked_search": search.op12,
}
# The others: 3 rests on a trained model, 4 and 6 on a tokeniser and a hash that SQL lacks.
ORACLE_SQL = {
    "op1_pii_disclosure": pii.sql(),
    "op2_license_index": licenses.sql(),
    "op5_suffix_repeats": repeats.SQL,
    "op7_url_filter": urlfilter.SQL,
    "op8_warc_transactions": warc.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_embedding_caps": embeddings.SQL,
    "op11_byte_shards": sharding.SQL,
    "op12_ranked_search": search.SQL,
}
