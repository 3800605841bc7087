"""The registered queries of this subpackage and their SQL."""

from hourgrid.llm import (decontaminate, hmm, langid, licenses, mixing, ngram_join, prefix_trie, quality, ranked_search, secrets,
                          tokens, tree_search, urls)

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_language_model": hmm.op3_language_model,
    "op4_language_id": langid.op4_language_id,
    "op5_quality": quality.op5_quality,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_url_filters": urls.op7_url_filters,
    "op8_tree_search": tree_search.op8_tree_search,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_license_scan": licenses.op13_license_scan,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op7_url_filters": urls.ORACLE_SQL,
    "op9_source_mix": mixing.ORACLE_SQL,
    "op10_secret_scan": secrets.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_ranked_search": ranked_search.ORACLE_SQL,
}
