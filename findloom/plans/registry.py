"""All registered queries of the finding jobs, with their DuckDB counterparts."""

from findloom.plans import oracles, queries

NAMES = (
    "intake_rejects intake_keys intake_accept intake_first_wins intake_events run_start run_counts run_failures run_events backlogs run_states runs_to_publish"
    " trivy_flatten sarif_flatten generic_flatten unparsed_elements severities severity_labels score_bands vuln_ids cwe_numbers purls paths cvss_v3 cvss_v2 components ratings finding_cwes"
    " fingerprints fingerprint_levels fingerprint_formats skipped_levels duplicate_groups candidate_pairs candidate_counts candidate_histogram candidate_places pair_scores verdict_counts representative_pairs verdicts_by_tool"
    " clusters_sca clusters_constrained review_queue cluster_stats confidence_histogram joined_clusters clusters_by_tool run_findings worst_findings top_ratings findings_by_cwe findings_by_component run_summary shared_clusters"
).split()
QUERIES = {n: getattr(queries, n) for n in NAMES}
ORACLES = {n: q for n, q in oracles.SQL.items() if n in QUERIES}
