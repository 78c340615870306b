"""Registry of the corpus operators' queries and of the SQL that some of them have."""

from __future__ import annotations

from . import collocation, decontaminate, exact_dedup, html_text, language, line_dedup, lm_score, mixing, secrets, sharding, simhash, spelling, url_filter

QUERIES = {
    "op1_spaced_seed_leaks": decontaminate.op1_spaced_seed_leaks,
    "op2_markov_url_filter": url_filter.op2_markov_url_filter,
    "op3_lsm_exact_dedup": exact_dedup.op3_lsm_exact_dedup,
    "op4_anchor_simhash": simhash.op4_anchor_simhash,
    "op5_line_block_text": html_text.op5_line_block_text,
    "op6_hyperdimensional_language": language.op6_hyperdimensional_language,
    "op7_automaton_secrets": secrets.op7_automaton_secrets,
    "op8_log_bilinear_score": lm_score.op8_log_bilinear_score,
    "op9_poisson_mix": mixing.op9_poisson_mix,
    "op10_prefix_sum_shards": sharding.op10_prefix_sum_shards,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_line_bitmaps": line_dedup.op12_line_bitmaps,
    "op13_phrase_growth": collocation.op13_phrase_growth,
}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLES = {
    "op1_spaced_seed_leaks": decontaminate.ORACLE,
    "op3_lsm_exact_dedup": exact_dedup.ORACLE,
    "op9_poisson_mix": mixing.ORACLE,
    "op10_prefix_sum_shards": sharding.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_line_bitmaps": line_dedup.ORACLE,
    "op13_phrase_growth": collocation.ORACLE,
}
