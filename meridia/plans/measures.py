"""Conditions on records that district measures count: name -> SQL that both engines read alike."""

MEASURES = {
    "trusted_rows": "trusted", "review_rows": "needs_review", "contradicted_rows": "contradicted", "critical_rows": "critical_gap", "source_rows": "coalesce(has_source, false)",
    "contact_rows": "coalesce(has_contact, false)", "website_rows": "has_website", "phone_rows": "has_phone", "mail_rows": "has_mail", "pin_rows": "pin IS NOT NULL", "pin_known_rows": "pin_known",
    "pin_ambiguous_rows": "coalesce(pin_ambiguous, false)", "joined_rows": "match_score IS NOT NULL", "exact_join_rows": "join_strategy = 'pincode_district_state_exact'",
    "fuzzy_join_rows": "join_strategy = 'pincode_district_state_fuzzy'", "fallback_join_rows": "join_strategy = 'facility_city_state_fallback'", "plausible_rows": "geo_quality = 'plausible'",
    "moderate_rows": "geo_quality = 'moderate'", "far_rows": "geo_quality = 'far'", "outside_rows": "geo_quality = 'outside'", "unplaced_rows": "geo_quality = 'missing'",
    "capacity_observed_rows": "capacity_status = 'observed_valid'", "capacity_outlier_rows": "capacity_outlier", "doctors_observed_rows": "doctors_status = 'observed_valid'",
    "doctors_outlier_rows": "doctors_outlier", "year_observed_rows": "year_status = 'observed_valid'", "recent_rows": "recency = 'valid'", "stale_rows": "recency = 'stale'",
    "bad_date_rows": "recency IN ('invalid', 'future')", "description_rows": "has_description", "specialties_rows": "has_specialties", "procedure_rows": "has_procedure",
    "equipment_rows": "has_equipment", "capability_rows": "has_capability", "maternity_rows": "maternity", "emergency_rows": "emergency", "diagnostic_rows": "diagnostic", "chronic_rows": "chronic",
    "private_rows": "coalesce(operator = 'private', false)", "public_rows": "coalesce(operator = 'public', false)", "trust_rows": "coalesce(operator = 'trust', false)",
    "three_gap_rows": "gaps >= 3", "gapless_rows": "gaps = 0", "full_claim_rows": "claim_fields = 5",
}
