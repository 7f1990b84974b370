"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from chartloom.llm import cotrain, covertree, decontam, hardneg, langid, lexical, neardup, secrets, suffixdedup, tokenfile, urlfilter, warc, wordbpe
from chartloom.llm.oracle import SQL  # noqa: F401

QUERIES = {
    f.__name__: f
    for f in (
        cotrain.op1_quality_classifier,
        suffixdedup.op2_suffix_array_dedup,
        langid.op3_language_id,
        decontam.op5_benchmark_decontamination,
        secrets.op6_secret_scans,
        warc.op4_warc,
        covertree.op7_exact_top_k,
        tokenfile.op8_token_files,
        wordbpe.op9_word_bpe,
        neardup.op10_minhash_near_dedup,
        lexical.op11_ranked_search,
        hardneg.op12_hard_negatives,
        urlfilter.op13_url_filters,
    )
}
