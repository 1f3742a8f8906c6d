"""Schemas of everything qscore reads, as DDL strings."""

# A snapshot: one row per regular file. ``content`` is one cell, like a file is one value.
FILES = "repo string, path string, content string"

FINDING_FIELDS = (
    "priority string, pillar string, location string, line_start int, line_end int, "
    "description string, remediation string, severity string"
)

SCORE = "repo string, total double, pillars map<string,double>, llm_enhanced boolean, timestamp timestamp"

# One organisation's policy file. Booleans keep three states (null, true, false).
POLICY = (
    "gate struct<target_threshold:double, fail_on_critical_security:boolean, "
    "llm:struct<provider:string, base_url:string, model_name:string, auth_type:string, "
    "api_key_env_var:string, timeout_ms:int, temperature:double, "
    "oauth_token_url:string, oauth_auth_url:string, oauth_client_id_env_var:string, "
    "oauth_client_secret_env_var:string, oauth_scopes:array<string>, "
    "oauth_redirect_url:string, oauth_token_cache_file:string>, "
    "privacy:struct<allow_public_cloud_transmission:boolean, data_scrubbing:boolean>>, "
    "pillars struct<static:struct<max_cyclomatic_complexity:int>, "
    "verification:struct<mutation_coverage_floor:double>>, "
    "exclusions struct<paths:array<string>>"
)

# A model's answer to a review request.
EVALUATION = (
    "pillar_adjustments struct<static_health_deduction:double, "
    "architecture_deduction:double>, "
    "remediations array<struct<priority:string, pillar:string, location:string, "
    "finding:string, actionable_fix:string>>"
)
