"""All queries of the core by name."""

from __future__ import annotations

from corpuscle.operators import duplicates, evidence, findings, interventions, leakage, models, profile, review, vectors

_BY_MODULE = {
    profile: "normalize_text text_sha256 shallow_features mask_promo mask_cues dataset_validation artifact_summary profile_summary split_comparison row_position_bins length_histogram label_crosstab feature_prevalence feature_prevalence_pivot mean_features",
    duplicates: "exact_duplicate_clusters exact_duplicate_members cluster_size_counts exact_leakage_cases duplicate_overview near_pair_reason_codes near_pairs_sensitivity",
    review: "review_queue adjudicated_queue review_summary review_counters sample_duplicate_rollup near_leakage_cases heldout_leakage_rollup leakage_top_examples",
    leakage: "leakage_summary leakage_partner_counts classification_metrics threshold_agreement leakage_metric_sensitivity leakage_aware_eval majority_baseline prediction_integrity",
    evidence: "knn_label_evidence label_error_candidates label_error_watchlist ambiguity_candidates shortcut_review_queue",
    interventions: "training_partner_removal exclude_leaked_heldout dedup_components dedup_keep_first overlay_effect cue_masking intervention_row_counts combined_view",
    findings: "finding_counts top_n_per_issue final_findings adjudication_memo submission_validation",
    vectors: "word_tfidf_weights near_pairs_word",
    models: "word_lr_oof shallow_lr_probe masked_lr intervention_metrics",
}
QUERIES = {name: getattr(module, name) for module, names in _BY_MODULE.items() for name in names.split()}
