"""Thresholds, word lists, labels and texts that results must carry exactly.

Everything in this module is data. The rules that use it live in ``plumbline.operators``.
"""

# --- thresholds ---------------------------------------------------------------------------
Z_SCORE_THRESHOLD = 2.5
STEP_CHANGE_THRESHOLD = 0.25
MIN_POINTS_FOR_TREND = 3
MIN_DEFINITION_LENGTH = 20
SPECIFIC_DEFINITION_LENGTH = 50
STABLE_RANGE_SHARE = 0.3
VARIATION_FLOOR = 0.01
MAX_ATTEMPTS = 3
MIN_CHART_POINTS = 2
AXIS_MARGIN = 5

# --- registry fields, in declaration order ------------------------------------------------
REGISTER_FIELDS = [
    "name",
    "definition",
    "formula",
    "time_period",
    "primary_source_system",
    "secondary_source_systems",
    "intended_audience",
    "identifier_fields",
    "source_systems_in_join",
    "data_owner",
    "data_steward",
    "known_limitations",
    "bias_or_equity_risks",
]
LIST_FIELDS = ["secondary_source_systems", "identifier_fields", "source_systems_in_join"]
REQUIRED_JSON_FIELDS = [
    "name",
    "definition",
    "formula",
    "time_period",
    "primary_source_system",
    "intended_audience",
    "data_owner",
    "data_steward",
    "known_limitations",
    "bias_or_equity_risks",
]
REVIEW_SCALAR_FIELDS = REQUIRED_JSON_FIELDS + ["human_signoff_required"]
REVIEW_LIST_FIELDS = LIST_FIELDS
GOVERNANCE_TEXT_FIELDS = [
    "data_owner",
    "data_steward",
    "known_limitations",
    "bias_or_equity_risks",
]

# --- word lists (case-insensitive substrings unless said otherwise) -----------------------
FORMULA_OPERATORS = ["/", "÷", "="]
RATIO_OPERATORS = ["/", "÷"]
SURVEY_TERMS = ["survey"]
UNIT_TERMS = ["percent", "percentage", "rate", "%"]
DIRECTION_TERMS = ["increase", "decrease", "maintain", "improve", "reduce", "higher", "lower"]
COMPARISON_TERMS = ["target", "goal", "peer", "benchmark", "compared to"]
SEGMENT_TERMS = ["demographic", "segment", "subgroup", "race", "ethnicity", "gender", "income"]
SEGMENT_ADVICE_TERMS = ["demographic", "segment"]
GOAL_TERMS = ["target", "goal"]
BOARD_TERMS = ["board", "cabinet", "trustees", "executive"]
CONTEXT_TERMS = ["target", "goal", "peer", "benchmark"]
STANDARD_SOURCE = "IPEDS"  # case-sensitive
STANDARD_TERMS = ["first-time", "full-time", "degree-seeking", "ipeds"]
PERIOD_HEADER_TERMS = ["period", "year", "term", "date", "fall", "spring"]
VALUE_HEADER_TERMS = ["value", "rate", "pct", "percent", "%", "count", "n"]

# --- step 1 -------------------------------------------------------------------------------
REGISTER_PASS = ("Pass", "All required metadata present.")
REGISTER_GAP = ("Needs Attention", "Missing required fields.")

# --- step 2 -------------------------------------------------------------------------------
DEFINITION_CLEAR = ("Clear", "Definition appears stable and usable.")
DEFINITION_AMBIGUOUS = (
    "Ambiguous",
    "Definition needs clarification before downstream checks.",
)
DEFINITION_SHORT = "Definition looks too short to be precise."
FORMULA_NO_OPERATOR = "Formula does not visibly show a calculation operator."
TIME_PERIOD_MISSING = "Time period is missing."
FOLLOW_UP_PROMPTS = [
    "State numerator in plain language.",
    "State denominator in plain language.",
    "State the exact census date or reporting window.",
    "Name the single source of record for each component.",
]

# --- step 3 -------------------------------------------------------------------------------
ENTITY_PASS = ("Pass", "Entity coherence looks manageable.")
ENTITY_FAIL = ("Fail", "Entity coherence risk is high, resolve before dashboard use.")
JOIN_WITHOUT_IDENTIFIERS = "Cross system join required but identifier fields are not listed."
JOIN_DUPLICATES = "Duplicate system names in join list, confirm intended join path."
RESOLUTION_YES = "Entity resolution required: Yes"
RESOLUTION_NO = "Entity resolution required: No"

# --- step 4 -------------------------------------------------------------------------------
QUALITY_PASS = ("Pass", "No anomalies detected in aggregates.")
QUALITY_REVIEW = ("Needs Human Review", "Anomalies detected, require human review.")
NON_NUMERIC_NOTE = "Value is missing or non numeric."
OUTLIER_NOTE = "Flag for review."
STEP_CHANGE_NOTE = "Confirm if institutional event explains change."
OUTLIER_RULE = "z score at or above {}"
STEP_CHANGE_RULE = "absolute percent change at or above {} percent"
REVIEW_RULE = "Required for every flagged anomaly"
MISSING_PERIOD = "Unknown"

# --- labels of the results quoted in a refinement prompt, in order ---------------------------
REFINEMENT_LABELS = [
    "Name",
    "Definition",
    "Formula",
    "Time Period",
    "Primary Source",
    "Data Owner",
    "Data Steward",
    "Known Limitations",
    "Bias/Equity Risks",
    "Readiness Status",
    "Blockers",
    "SMART Issues",
    "Tufte Issues",
    "Industry Gaps",
]

# --- step 5 -------------------------------------------------------------------------------
AI_USE = ("Pass", "AI techniques remain limited, explainable, and governed.")
LINKAGE_TECHNIQUE = "Entity resolution to unify records across systems"
LINKAGE_RATIONALE = "Multiple systems require reliable record linkage."
SCREENING_TECHNIQUE = "Anomaly detection to flag potential data errors in aggregates"
SCREENING_RATIONALE = (
    "Aggregate screening supports faster dashboards, without auto correction."
)
COMMENT_TECHNIQUE = "Natural language processing to organize open ended survey comments"
COMMENT_RATIONALE = "NLP can structure comments into themes for review."
EXCLUDED_TECHNIQUES = [
    "Automated decisions affecting individuals",
    "Black box scoring without documentation",
    "Auto correction of records without human review",
]

# --- step 6 -------------------------------------------------------------------------------
GOVERNANCE_COMPLETE = ("Complete", "Governance elements present.")
GOVERNANCE_INCOMPLETE = ("Incomplete", "Governance gaps, fill before publishing.")
SIGNOFF_MISSING = "human_signoff_required must be True"
GUARDRAILS = [
    "Human oversight required",
    "Bias checks documented",
    "Transparent documentation and change log",
]

# --- step 7 -------------------------------------------------------------------------------
READY = (
    "Ready for Dashboard Use",
    "KPI meets definition, quality, and governance requirements.",
)
NOT_READY = ("Not Ready", "KPI blocked by one or more gaps.")
BLOCKER_DEFINITION = "Definition ambiguous"
BLOCKER_ENTITY = "Entity coherence high risk"
BLOCKER_QUALITY = "Data anomalies require review"
BLOCKER_GOVERNANCE = "Governance incomplete"
NEXT_ACTIONS_BLOCKED = [
    "Clarify definition and formula",
    "Confirm sources of record and join keys",
    "Review anomalies with domain owners",
    "Complete governance fields and require sign off",
]
NEXT_ACTIONS_READY = ["Proceed to dashboard with documented caveats"]
READINESS_NOTE = "Steps 9-10 provide quality insights but don't affect readiness status"

# --- step 8 -------------------------------------------------------------------------------
SUMMARY_GENERATED = ("Generated", "One page readiness summary prepared.")

# --- step 9: design criteria --------------------------------------------------------------
SMART_CRITERIA = ["Specific", "Measurable", "Achievable", "Relevant", "Time-bound"]
SPECIFIC_STRENGTH = "Clear population and outcome defined"
SPECIFIC_ISSUE = "Definition could be more precise (currently < 50 characters)"
MEASURABLE_STRENGTH = "Formula with clear calculation operator"
MEASURABLE_ISSUE = "Formula lacks clear calculation operator"
ACHIEVABLE_STRENGTH = "Historical data shows stable, realistic range (variance: {:.1f})"
ACHIEVABLE_ISSUE = "High variance suggests volatility or data quality concerns"
RELEVANT_STRENGTH = "Clear audience defined: {}"
RELEVANT_ISSUE = "Intended audience not specified"
TIME_BOUND_STRENGTH = "Reporting cycle defined: {}"
TIME_BOUND_ISSUE = "Reporting cycle not specified"

VISUAL_CRITERIA = [
    "data_ink_ratio",
    "chartjunk_avoidance",
    "data_density",
    "small_multiples",
    "narrative_clarity",
]
RATIO_AND_TREND = "KPI is a ratio with time series (high data density)"
RATIO_ONLY = "KPI is a ratio (meaningful comparison)"
TREND_ONLY = "Count-based KPI without ratio context (lower data-ink ratio)"
NO_RATIO_NO_TREND = "Lacks both ratio structure and time series"
UNITS_AND_DIRECTION = "Clear units and direction (minimal interpretation needed)"
UNITS_ONLY = "Standard percentage units (easy to understand)"
UNITS_UNCLEAR = "Units or direction unclear (may need extra context)"
COMPARISON_AND_VARIATION = "Has comparison context and meaningful variation"
COMPARISON_ONLY = "Has comparison context (target or benchmark)"
VARIATION_ONLY = "Has variation but lacks comparison context (add target/peer)"
NO_COMPARISON = "Lacks both comparison context and meaningful variation"
SEGMENTS_READY = "Can be disaggregated for equity monitoring (small multiples)"
SEGMENTS_MISSING = "Not identified as disaggregatable by demographic group"
NARRATIVE_DIRECTED = "Clear narrative: actionable with defined direction"
NARRATIVE_OWNED = "Actionable with clear ownership"
NARRATIVE_MISSING = "Lacks clear ownership or direction for action"
VISUAL_SOURCE = "Tufte, E. (2001). The Visual Display of Quantitative Information"
DESIGN_NOTE = "SMART = Specific, Measurable, Achievable, Relevant, Time-bound; Tufte = Data-ink ratio, Chartjunk avoidance, Data density, Small multiples, Narrative clarity"

ADVISE_SEGMENTS = "Consider disaggregating by demographic group for equity monitoring"
ADVISE_GOAL = (
    "Define explicit target or goal (e.g., 'maintain above 85%' or 'improve to 90% by 2028')"
)
ADVISE_TREND = (
    "Consider adding trend expectation to definition "
    "(e.g., 'trending upward' or 'maintain stability')"
)
ADVISE_COMPARISON = (
    "Add comparison context (peer institution, national average, or historical baseline)"
)
ADVISE_DIRECTION = (
    "Clarify direction in definition (e.g., 'higher is better' or 'maintain stability')"
)
ADVISE_RATIO = "Consider converting to rate or ratio for better visualization"

GOOD_DESIGN_SCORE = 4
DESIGN_STRONG = ("Strong Design & Visualization-Ready", "Dashboard-ready.")
DESIGN_NEEDS_VISUALS = (
    "Strong Design, Needs Visualization Enhancement",
    "Consider visualization improvements.",
)
DESIGN_NEEDS_REFINEMENT = (
    "Visualization-Ready, Needs Design Refinement",
    "Address design gaps.",
)
DESIGN_WEAK = ("Needs Refinement", "Address both design and visualization.")
DESIGN_SKIPPED = ("Skipped", "Design assessment disabled by configuration")

# --- step 10: sector standards (organization, check, standard, reference) -----------------
STANDARDS = [
    ("EDUCAUSE", "data_governance", "Clear data ownership and stewardship",
     "EDUCAUSE Data Governance Framework (2023)"),
    ("EDUCAUSE", "equity_consideration", "Bias and equity risks documented",
     "EDUCAUSE Analytics Maturity Model"),
    ("EDUCAUSE", "limitations_documented", "Known limitations clearly stated",
     "EDUCAUSE Data Quality Standards"),
    ("AGB", "board_appropriate", "Intended for board/cabinet strategic oversight",
     "AGB Dashboard Metrics for Boards (2022)"),
    ("AGB", "multi_year_trend", "Multi-year trend data available (3+ years)",
     "AGB Board Responsibilities for Strategic Planning"),
    ("AGB", "contextualized", "Includes target or peer comparison for context",
     "AGB Benchmarking for Boards"),
    ("NACUBO", "standard_definitions",
     "Uses standard definitions (IPEDS-aligned where applicable)",
     "NACUBO KPI Framework (2024)"),
    ("NACUBO", "multi_year_data", "Multi-year historical data for trend analysis",
     "NACUBO Business Intelligence Best Practices"),
    ("NACUBO", "auditable", "Formula and source system documented for auditability",
     "NACUBO Financial Reporting Standards"),
]
ORGANIZATIONS = ["EDUCAUSE", "AGB", "NACUBO"]
ORGANIZATION_LABELS = {
    "EDUCAUSE": "EDUCAUSE - Data Governance & Analytics",
    "AGB": "AGB - Board Governance & Oversight",
    "NACUBO": "NACUBO - Financial & Operational Rigor",
}
STANDARDS_NOTE = "Industry standards from EDUCAUSE, AGB (Association of Governing Boards), and NACUBO (National Association of College and University Business Officers)"
STRONG_ALIGNMENT_PERCENT = 85
PARTIAL_ALIGNMENT_PERCENT = 70
ALIGNMENT_STRONG = ("Strong Alignment", "Exceeds industry standards")
ALIGNMENT_PARTIAL = ("Partial Alignment", "Meets most industry standards")
ALIGNMENT_WEAK = ("Needs Enhancement", "Significant gaps in industry alignment")
STANDARDS_SKIPPED = ("Skipped", "Best practices assessment disabled by configuration")

# --- summaries and dashboard values -------------------------------------------------------
NO_BLOCKERS = "None — proceed to dashboard with documented caveats"
NO_SECONDARY = "None"
SUMMARY_IDENTITY = "KPI VALIDATED"
SUMMARY_RESULTS = "READINESS RESULTS"
SUMMARY_BLOCKERS = "BLOCKERS"
SUMMARY_GOVERNANCE = "GOVERNANCE"
BATCH_HEADER = [
    "KPI Name",
    "Readiness Status",
    "Definition Status",
    "Entity Risk",
    "Anomalies Detected",
    "Governance Status",
    "Design Quality",
    "Industry Standards",
    "Blockers",
]
FIELD_NOT_FOUND = "NOT FOUND"
LIST_EMPTY = "(none)"
NOT_AVAILABLE = "N/A"
NOT_SPECIFIED = "Not specified"
SIGNOFF_LABELS = ("Required", "Not set")
SENTIMENTS = ["positive", "negative", "mixed", "neutral"]
DEFAULT_SENTIMENT = "neutral"
DEFAULT_OVERALL_SENTIMENT = "mixed"
DEFAULT_PLACEHOLDER_PERIOD = "annually"

# --- survey comments ----------------------------------------------------------------------
COMMENT_CATEGORIES = {
    "Registration & Enrollment": [
        "registration", "enroll", "waitlist", "schedule", "course",
    ],
    "Advising & Support": [
        "advisor", "advising", "counselor", "support", "helpful",
    ],
    "Financial Aid & Billing": [
        "financial", "aid", "tuition", "payment", "award", "billing",
    ],
    "Facilities & Resources": [
        "library", "study", "campus", "facility", "space", "hours",
    ],
    "Faculty & Instruction": [
        "professor", "instructor", "feedback", "office hours", "teaching",
    ],
    "Career Services": [
        "career", "internship", "job", "employment", "placement",
    ],
}
SAMPLE_COMMENTS = [
    "Registration system is confusing and takes too long to navigate.",
    "My advisor has been incredibly helpful and always responds quickly.",
    "Financial aid process needs clearer instructions and better communication.",
    "I love the library hours and the study spaces available on campus.",
    "The advising office needs more staff, wait times are too long.",
    "Tuition payment portal crashes frequently and is hard to use.",
    "Career services helped me land an internship, very grateful.",
    "Course registration should allow waitlisting across all departments.",
    "The financial aid award letter was confusing and hard to understand.",
    "My professor gives great feedback and makes office hours accessible.",
]

# --- stand-ins used when a model response cannot be read ----------------------------------
PLACEHOLDER_SERIES = [
    ("Fall 2020", 71.0),
    ("Fall 2021", 72.5),
    ("Fall 2022", 71.8),
    ("Fall 2023", 73.4),
    ("Fall 2024", 74.2),
]
FALLBACK_CATEGORIES = [
    ("Registration & Enrollment", 2, "negative",
     "Students report confusion with registration system"),
    ("Advising & Support", 2, "mixed", "Advising valued but understaffed"),
    ("Financial Aid & Billing", 3, "negative",
     "Financial aid communication needs improvement"),
    ("Faculty & Instruction", 2, "positive", "Faculty feedback and accessibility praised"),
    ("Career Services", 1, "positive", "Career services delivering strong outcomes"),
]
FALLBACK_FLAGS = [
    "Registration system crashes during peak enrollment periods",
    "Financial aid award letters are incomprehensible",
]
FALLBACK_OVERALL = "mixed"
FALLBACK_INSIGHT = (
    "Strong faculty support contrasts with systemic issues in registration and financial aid."
)
