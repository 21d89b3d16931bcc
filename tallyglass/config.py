"""Frozen configurations: topics, themes, areas, tactics and word lists.

Values in this module are fixed: results depend on each of them and on their order. Matching is
by substring of the lower-cased text everywhere, not by word.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Topic:
    """An outcome with the words that find spending on it. ``strict`` is matched on titles only."""

    indicator: str
    group: str
    lower_is_better: bool
    terms: tuple[str, ...]
    strict: tuple[str, ...]
    narrative_query: str = ""


@dataclass(frozen=True)
class Theme:
    key: str
    label: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Area:
    key: str
    label: str
    metric_keywords: tuple[str, ...]
    action_keywords: tuple[str, ...]
    service: str


# The attendance vocabulary of the topic.
_ATTENDANCE = ("chronic absentee", "attendance", "absen", "truanc", "re-engagement", "reengagement", "home visit", "sarb", "sart")

TOPICS = {
    "chronic_absenteeism": Topic(
        indicator="chronic_absenteeism",
        group="ALL",
        lower_is_better=True,
        terms=_ATTENDANCE,
        strict=_ATTENDANCE,
        narrative_query="chronic absenteeism attendance barriers family outreach student re-engagement truancy home visits",
    )
}

# The vocabulary of the declining-rate report differs from the topic's.
REPORT_TERMS = ("attendance", "absen", "truanc", "re-engagement", "home visit", "sarb")

# The first class with a hit names the action.
SELLABLE = (
    ("software_or_data_system", ("software", "platform", "system", "dashboard", "data", "analytics", "monitor")),
    ("outreach_workflow", ("outreach", "message", "messaging", "communication", "notify", "phone", "text", "family engagement")),
    ("case_management_or_services", ("case management", "home visit", "liaison", "re-engagement", "reengagement")),
    ("attendance_intervention", ("sarb", "sart", "truancy", "attendance team", "attendance intervention")),
)
BUNDLED = ("base:", "base ", "ongoing operating", "on-going operating", "instruction", "teacher", "staffing", "personnel", "salary", "salaries", "benefits", "maintenance")
LARGE_BUNDLE = 5_000_000
# Class -> (confidence, reading).
ACTIONABILITY_READS = {
    "sellable": ("high", "Likely vendor-addressable or operationally addressable attendance work."),
    "bundled_or_staffing": ("low", "Budget may be large but likely bundled into staffing, base operations, or broad programs."),
    "large_unclear_bundle": ("low", "Large budget with unclear vendor-addressable wedge; inspect source pages before outreach."),
    "unclear": ("medium", "Potential opportunity, but action details need review."),
}

# Indicator ids.
INDICATORS = {
    "1": "chronic_absenteeism",
    "2": "suspension_rate",
    "3": "english_learner_progress",
    "4": "graduation_rate",
    "5": "college_career",
    "6": "ela",
    "7": "math",
    "8": "science",
    "cci": "college_career",
    "elpi": "english_learner_progress",
    "elpi_2024": "english_learner_progress",
}

# Words that district names are compared without, and abbreviations.
NAME_STOP_WORDS = ("school", "schools", "district", "unified", "elementary", "union", "high", "county", "office", "of", "education", "coe", "joint", "city", "sbe", "the")
NAME_REPLACED = {"mt": "mount"}
# Fixed value: how a parsed name starts that is the title of the form only.
PLACEHOLDER_NAME = "LCAP 2025 -"

# Words a text query leaves out.
QUERY_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "of", "on", "or", "our", "show", "that", "the", "their", "to", "with")
QUERY_TOKENS = 24

# Metrics that are better when lower, of the theme report and of the area report.
REPORT_LOWER_IS_BETTER = ("absen", "suspension", "dropout", "discipline", "incident", "expulsion", "chronic absentee", "d grade", "f grade", "missing", "misassign", "deficien", "complaint", "proportionally", "disproportion", "rate of d", "rate of f")
REPORT_LOWER_PHRASES = ("less than", "at most", "no more than", "decrease", "reduce")
AREA_LOWER_IS_BETTER = ("absen", "suspension", "dropout", "discipline", "incident", "expulsion", "chronic absentee", "d grade", "f grade", "missing", "misassign", "deficien", "complaint", "rate of d", "rate of f", "tier 3", "recommended for tier 3", "needing tier 3", "needs tier 3", "students recommended", "students needing")

# Themes in order of preference on ties.
THEMES = (
    Theme("academic_instruction", "Academic Achievement & Instruction", ("english language arts", "ela", "mathematics", "math", "science", "state standards", "instruction", "curriculum", "assessment", "academic", "literacy", "broad course of study", "a-g deficiency", "caaspp", "cast", "gpa")),
    Theme("college_career", "College, Career & Graduation", ("college", "career", "graduation", "graduate", "a-g", "uc/csu", "pathway", "cte", "advanced placement", "baccalaureate", "dual enrollment", "postsecondary", "seal of biliteracy", "seal of civic", "ap ", "ib ")),
    Theme("attendance_climate", "Attendance, Belonging & School Climate", ("attendance", "absentee", "suspension", "school climate", "belonging", "behavior", "restorative", "pbis", "social-emotional", "well-being", "wellness", "mental health", "sense of belonging", "connectedness", "school safety", "school culture")),
    Theme("family_community", "Family & Community Engagement", ("family", "parent", "community", "engagement", "advisory", "communication", "outreach", "partnership", "faces", "delac", "elac", "school site council", "community school")),
    Theme("english_learner", "English Learner & Multilingual Support", ("english learner", "english language development", "eld", "elpac", "reclassification", "rfep", "ltel", "multilingual", "plurilingual", "language acquisition", "biliteracy")),
    Theme("special_education", "Special Education & Inclusion", ("special education", "students with disabilities", "swd", "sped", "inclusion", "udl", "iep", "exceptional needs", "caa", "alternate assessment", "extended school year", "esy")),
    Theme("technology_data", "Technology, Data & Systems", ("technology", "digital", "software", "device", "wifi", "data", "dashboard", "progress monitoring", "platform", "assessment system", "schoolinks", "classlink", "schoology", "library/media", "artificial intelligence")),
    Theme("intervention_extended_learning", "Intervention, MTSS & Expanded Learning", ("intervention", "mtss", "tier 2", "tier 3", "tutorial", "tutoring", "summer school", "after school", "expanded learning", "extended learning", "credit recovery", "case management", "acceleration", "independent study", "academic support")),
    Theme("staffing_prof_learning", "Staffing & Professional Learning", ("staffing", "staff", "professional learning", "professional development", "plc", "coach", "coaching", "induction", "mentor", "teacher training", "administrator training", "recruiting", "retaining", "personnel")),
)
OTHER_THEME = ("other", "Other / uncategorized")

# Opportunity areas in order of preference on ties.
AREAS = (
    Area(
        "chronic_absenteeism",
        "Chronic Absenteeism & Attendance Recovery",
        ("chronic absenteeism", "attendance rate", "absentee", "truancy"),
        ("attendance", "absentee", "truancy", "re-engagement", "attendance intervention", "home visit", "attendance support"),
        "Attendance early-warning, multilingual family outreach, case management workflows, and student re-engagement services.",
    ),
    Area(
        "school_climate_suspension",
        "School Climate, Behavior & Suspension",
        ("suspension", "school climate", "discipline", "belonging", "connectedness", "school safety", "adult they trust", "happy to be at this school"),
        ("pbis", "restorative", "discipline", "behavior", "school climate", "belonging", "connectedness", "student behavior", "restorative practices"),
        "Behavior support systems, restorative-practice implementation, school-climate coaching, and student support programming.",
    ),
    Area(
        "ela_proficiency",
        "ELA Proficiency & Literacy",
        ("english language arts", "ela", "literacy", "reading", "writing", "caaspp - ela", "caaspp ela", "sbac) english language arts", "research/inquiry"),
        ("english language arts", "ela", "literacy", "reading", "writing", "reading intervention", "literacy intervention"),
        "High-dosage literacy intervention, instructional coaching, assessment/data cycles, and targeted tutoring support.",
    ),
    Area(
        "math_proficiency",
        "Math Proficiency",
        ("mathematics", "math", "caaspp - math", "caaspp math", "sbac) mathematics", "algebra", "numeracy"),
        ("math", "mathematics", "algebra", "numeracy", "math intervention"),
        "Math intervention, acceleration supports, classroom coaching, and benchmark-driven instructional services.",
    ),
    Area(
        "english_learner_progress",
        "English Learner Progress & Reclassification",
        ("english learner", "elpac", "reclassification", "rfep", "ltel", "elpi"),
        ("english learner", "english language development", "eld", "reclassification", "rfep", "ltel", "newcomer", "multilingual", "plurilingual"),
        "ELD program support, reclassification tracking, newcomer services, multilingual family engagement, and teacher coaching.",
    ),
    Area(
        "graduation_credit_recovery",
        "Graduation, Credit Recovery & Alternative Pathways",
        ("graduation", "dropout", "credit recovery"),
        ("graduation", "credit recovery", "continuation", "alternative school", "independent study", "case management", "on-time graduation"),
        "Credit-recovery programs, mentoring/case management, alternative pathway support, and early-warning graduation services.",
    ),
    Area(
        "college_career_readiness",
        "College, Career & Postsecondary Readiness",
        ("college and career", "college/career", "college/career indicator", "a-g", "uc/csu", "cte", "pathway", "career readiness", "postsecondary", "college going", "seal of biliteracy"),
        ("college and career", "college/career", "a-g", "uc/csu", "cte", "pathway", "dual enrollment", "advanced placement", "baccalaureate", "career readiness", "postsecondary", "college going", "seal of biliteracy"),
        "College/career pathway design, advising systems, pathway activation, dual-enrollment operations, and postsecondary planning platforms.",
    ),
    Area(
        "family_community_engagement",
        "Family & Community Engagement",
        ("family", "parent", "family survey", "parent survey", "parent engagement", "family engagement", "community engagement", "delac", "elac", "school site council"),
        ("family", "parent", "community engagement", "family engagement", "parent engagement", "outreach", "translator", "community school", "advisory", "delac", "elac", "family advocacy"),
        "Multilingual family engagement platforms, community outreach services, workshop programming, and parent activation campaigns.",
    ),
    Area(
        "mental_health_wellness",
        "Mental Health, SEL & Wellness",
        ("mental health", "social-emotional", "well-being", "wellness", "socioemotional"),
        ("mental health", "wellness", "social-emotional", "sel", "counseling", "psychologist", "social worker", "well-being", "trauma-informed"),
        "Mental health program delivery, wellness curricula, SEL implementation, counseling supports, and referral/case-management tools.",
    ),
    Area(
        "mtss_intervention",
        "MTSS, Tutoring & Targeted Intervention",
        ("tier 2", "tier 3", "expanded learning", "extended learning", "intervention", "progress monitoring"),
        ("mtss", "intervention", "tutoring", "tutorial", "tier 2", "tier 3", "summer school", "after school", "extended learning", "expanded learning", "progress monitoring"),
        "MTSS implementation support, tutoring operations, expanded-learning programming, and intervention workflow/data tools.",
    ),
    Area(
        "special_education_inclusion",
        "Special Education & Inclusion",
        ("special education", "students with disabilities", "swd", "caa", "exceptional needs", "esy"),
        ("special education", "students with disabilities", "swd", "sped", "inclusion", "udl", "caa", "exceptional needs", "esy"),
        "Inclusive instruction support, SPED program services, progress monitoring, extended school year supports, and compliance/implementation tools.",
    ),
    Area(
        "data_technology",
        "Data Systems & Instructional Technology",
        ("progress monitoring", "technology to access curriculum", "online assessment"),
        ("technology", "software", "platform", "device", "wifi", "data system", "data warehouse", "schoolinks", "classlink", "schoology", "digital"),
        "Instructional technology, student support platforms, progress dashboards, workflow systems, and district data integration.",
    ),
)

# Ordered classes of procurement with the share that can be bought outside.
PROCUREMENT = (
    ("technology_platform", 0.90, ("software", "platform", "license", "online", "app", "digital tool", "schoolinks", "classlink", "schoology", "warehouse")),
    ("coaching_pd_services", 0.70, ("consultant", "coaching", "coach", "professional development", "training", "workshop", "technical assistance")),
    ("program_services", 0.65, ("tutoring", "tutorial", "after school", "summer school", "intervention", "case management", "mentoring")),
    ("community_support_services", 0.60, ("community partner", "partnership", "translator", "outreach", "engagement specialist", "mental health", "counseling", "wellness")),
    ("materials_resources", 0.55, ("curriculum", "materials", "books", "supplies", "resources", "assessment", "devices", "hot spot", "hotspot")),
    ("internal_staffing", 0.20, ("staffing", "staff", "teacher", "administrator", "classified", "personnel", "salary", "specialist", "tosa", "fte", "psychologist", "social worker", "nurse")),
)
OTHER_PROCUREMENT = ("mixed_or_unclear", 0.40)

# The vocabulary of explicit attendance titles, of workflow titles, and of tactics.
EXPLICIT_TITLE = ("attendance", "absentee", "truancy", "re-engagement", "reengagement", "absence", "sart", "sarb", "a2a", "schoolstatus", "attention2attendance", "home visit")
WORKFLOW_TITLE = ("message", "messaging", "communication", "outreach", "liaison", "home visit", "conference", "portal", "phone", "call", "text", "notification", "team", "committee")
TACTICS = {
    "Attendance Platforms": ("a2a", "attention2attendance", "schoolstatus"),
    "Home Visits": ("home visit",),
    "SART / SARB": ("sart", "sarb"),
    "Attendance Teams / Protocols": ("attendance team", "attendance committee", "protocol"),
    "Messaging / Outreach": ("attendance messaging", "messaging", "personal outreach", "communication", "outreach"),
    "Liaisons / Family Support": ("liaison", "family conference", "re-engagement", "reengagement"),
}
NEGATIVE_STATUSES = ("off_track", "moving_away")

# Order of contact roles.
CONTACT_ROLES = ("superintendent", "chief_business_official", "cds_coordinator")


def normal_name(name: str) -> str:
    """A configuration or option name as it is looked up: trimmed, lower case, with underscores."""
    return name.strip().casefold().replace("-", "_").replace(" ", "_")


def topic(name: str) -> Topic:
    key = normal_name(name)
    if key not in TOPICS:
        raise ValueError(f"Unsupported topic '{name}'. Supported topics: {', '.join(sorted(TOPICS))}.")
    return TOPICS[key]
