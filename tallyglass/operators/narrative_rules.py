"""Fixed values of the narrative extraction: markers, section and prompt patterns, line rules.

Results depend on each value and on the order of the lists. Patterns ignore letter case.
"""

# Sizes in estimated tokens.
TARGET_TOKENS, MAX_TOKENS, OVERLAP_TOKENS, MIN_TOKENS = 720, 920, 100, 45

# Fixed values: (section type, label, pattern) in order of preference.
SECTIONS = (
    ("plan_summary", "Plan Summary", r"^Plan Summary(?:\s*\[[^\]]+\])?$"),
    ("plan_summary", "Resumen del Plan", r"^Resumen del Plan"),
    ("plan_summary", "General Information", r"^General Information$"),
    ("plan_summary", "Información General", r"^Información General$"),
    ("plan_summary", "Reflections: Annual Performance", r"^Reflections:\s*Annual Performance"),
    ("plan_summary", "Reflexiones: Desempeño Anual", r"^Reflexiones:\s*Desempeño Anual"),
    ("plan_summary", "Reflections: Technical Assistance", r"^Reflections:\s*Technical Assistance"),
    ("plan_summary", "Reflexiones: Ayuda Técnica", r"^Reflexiones:\s*Ayuda Técnica"),
    ("support_for_identified_schools", "Support for Identified Schools", r"^(Comprehensive Support and Improvement|Support for Identified Schools)"),
    ("support_for_identified_schools", "Apoyo para Escuelas Identificadas", r"^(Apoyo y Mejoramiento Integral|Apoyo para Escuelas Identificadas)"),
    ("monitoring_effectiveness", "Monitoring and Evaluating Effectiveness", r"^Monitoring and Evaluating Effectiveness"),
    ("monitoring_effectiveness", "Supervisando y Evaluando Efectividad", r"^Supervisando y Evaluando Efectividad"),
    ("engaging_partners", "Engaging Educational Partners", r"^Engaging Educational Partners"),
    ("engaging_partners", "Participación de Compañeros Educativos", r"^Participación de (?:Compañeros|Socios) Educativos"),
    ("goals_actions", "Goals and Actions", r"^Goals and Actions"),
    ("goals_actions", "Metas y Acciones", r"^Metas y Acciones"),
    ("goal_analysis", "Goal Analysis", r"^Goal Analysis(?:\s*\[[^\]]+\])?$"),
    ("goal_analysis", "Análisis de Meta", r"^Análisis de (?:la )?Meta"),
    ("increased_improved_services", "Increased or Improved Services", r"^Increased or Improved Services"),
    ("increased_improved_services", "Aumento o Mejora de Servicios", r"^Aumento o Mejora de Servicios"),
    ("required_descriptions", "Required Descriptions", r"^Required Descriptions"),
    ("required_descriptions", "Descripciones Requeridas", r"^Descripciones Requeridas"),
    ("equity_multiplier", "Equity Multiplier", r"^Equity Multiplier"),
    ("equity_multiplier", "Multiplicador de Equidad", r"^Multiplicador de Equidad"),
)
SECTION_CHARS, SECTION_LINES = 180, 9
ANYWHERE = ("required_descriptions", "goal_analysis")

# Fixed values: (prompt, pattern) in order of preference.
PROMPTS = (
    ("implementation", r"^(Describe|A description of).{0,90}implementation"),
    ("implementation", r"^(Describa|Una descripción).{0,120}implementación"),
    ("effectiveness", r"^(Describe|A description of).{0,120}effectiveness|ineffectiveness"),
    ("effectiveness", r"^(Describa|Una descripción).{0,140}efectiv"),
    ("material_differences", r"material differences"),
    ("material_differences", r"diferencias materiales"),
    ("changes", r"changes made to the planned goal|changes made to the planned"),
    ("changes", r"cambios (?:hechos|realizados).{0,120}(?:meta|planeada|planificada)"),
    ("partner_engagement", r"educational partners|input from"),
    ("partner_engagement", r"compañeros educativos|socios educativos|comentarios de"),
    ("increased_improved_services", r"increased or improved services"),
    ("increased_improved_services", r"aumento o mejora de servicios"),
    ("needs_conditions", r"needs, conditions|performance gaps|identified needs"),
    ("needs_conditions", r"necesidades, condiciones|brechas de rendimiento|necesidades identificadas"),
)
PROMPT_CHARS, PROMPT_WORDS = 360, 4

GOAL = r"(?i)^(?:broad\s+|focus\s+|maintenance\s+)?(?:goal|meta)\s+(\d+(?:\.\d+)?[A-Za-z]?)\b"
ACTION = r"(?i)^(?:Action|Acción)\s+(\d+(?:\.\d+)?[A-Za-z]?)\b"
TABLE_HEADER = r"(?i)\b(metric #|baseline|year 1 outcome|year 2 outcome|target for year 3|current difference|action #|action title|total funds|planned expenditures|contributing to increased|goal #\s+description\s+type of goal|# de medida|resultado del año|objetivo para\s+resultado del año|fondos totales)\b"

# Pages and segments with one of these are form text, budgets or tables.
TEMPLATE = (
    "local control and accountability plan instructions",
    "lcap instructions",
    "instructions: introduction",
    "instructions: plan summary",
    "instrucciones para completar",
    "requisitos e instrucciones",
    "para preguntas adicionales o ayuda técnica",
    "for additional questions or technical assistance",
    "the lcap template must be completed by all leas",
    "the following tables are required to be included as part of the lcap adopted",
    "for each action, provide the following information",
    "a well-developed plan summary section provides",
    "school districts and county offices of education must",
    "leas must provide a justification",
    "california department of education, july",
    "california department of education november",
)
TEMPLATE_FROM_PAGE, BUDGET_TO_PAGE = 20, 10
BUDGET_OVERVIEW = (
    "lcff budget overview for parents",
    "resumen presupuestario lcff para los padres",
    "budgeted expenditures in the lcap",
    "projected lcff supplemental and/or concentration grants",
    "ingreso proyecto por fuente financiera",
)
FUNDING_SUMMARY = (
    "total projected lcff supplemental",
    "total proyectado de subvenciones suplementarias",
    "required percentage to increase or improve services",
    "porcentaje requerido para aumentar o mejorar servicios",
)
TABLE_PAGE = (
    "prior action/service title",
    "last year's planned expenditures",
    "estimated actual expenditures",
    "total planned expenditures table",
    "contributing actions table",
    "annual update table",
    "lcff carryover table",
    "projected lcff base grant",
    "planned percentage of improved services",
    "planned expenditures for contributing actions",
    "scope unduplicated student group",
)
SOFT_TABLE_TAIL = ("action # total funds", "annual update table", "lcff carryover")
BUDGET_REFERENCE = "the budgeted expenditures for actions identified as contributing may be found"

# A line that holds all words of one entry starts a structured table.
TABLE_STARTS = (
    ("action #", "title"),
    ("action #", "total funds"),
    ("metric #", "baseline"),
    ("goal #", "description", "type of goal"),
    ("measuring and reporting results",),
    ("midiendo y reportando resultados",),
    ("# de meta", "necesidades identificadas"),
    ("# de medida", "referente"),
    ("year 1 outcome", "target year 3"),
    ("year 1 outcome", "current difference outcome"),
    ("resultado del año", "diferencia actual"),
)

# What is removed from a line, in order; of a pair the second part takes its place.
LINE_REMOVALS = (
    r"(?i)^.*?Local Control and Accountability Plan(?:\s*\(LCAP\))?\s*\|\s*[A-Z]+ \d{1,2}, \d{4}\s*",
    r"(?i)^(?:\d{4}-\d{2}\s+)?Local Control and Accountability Plan for .+? Page \d+ of \d+\s*",
    r"(?i)^(?:\d{4}-\d{2}\s+)?Plan de Rendición de Cuentas con Control Local .+? Página \d+ de \d+\s*",
    r"(?i)^Local Control and Accountability Plan Template\s*",
    r"(?i)^Plan de Rendición de Cuentas con Control Local\s*",
    r"(?i)^Goal\s*#\s*Description\s+(?:Type of Goal\s+)?(?:\d+(?:\.\d+)?[A-Za-z]?\s+)?",
    r"(?i)^Goal\s+Goal\s*#\s*Description\s+(?:Type of Goal\s+)?(?:\d+(?:\.\d+)?[A-Za-z]?\s+)?",
    r"(?i)\b(?:Focus|Broad|Maintenance)?\s*Goal\s+Goal\s*#\s*Description(?:\s+Type of Goal)?\s*",
    r"(?i)\bGoal\s*#\s*Description\s+Type of Goal\s*",
    r"(?i)^Goal and\s+Action #\s+Identified Need\(s\)\s+",
    r"(?i)^How the Action\(s\).+?Metric\(s\) to Monitor\s+Effectiveness\s*",
    r"(?i)^(?:with\s+)?(?:an?\s+)?(?:Improved Services|Planned Percentage of Improved Services)\s+in the Contributing Summary Table rather than.*?as applicable\.\s*",
    (r"(?i)\bAdditional Concentration Grant Funding\s+A description of the plan for how the additional concentration grant add-on funding.*?as applicable\.\s*", "Additional Concentration Grant Funding: "),
    r"(?i)\b(?:Metric #\s*[\w\s.,/-]{0,80})?Identified Need\(s\)\s+How the Action\(s\).*?Metric\(s\) to Monitor\s*",
)
# A line ends where one of these begins.
LINE_TAIL = r"(?i)\b(?:Please refer to the below table|Action #\s+Total Funds|2024\s+LCAP\s+Annual Update for the 2023-24 LCAP|2025-26\s+Local Control and Accountability|2025-26\s+Plan de Rendición de Cuentas con Control Local|Instructions\s+For additional questions or technical assistance|For additional questions or technical assistance|Requirements and Instructions|Requisitos e Instrucciones|Para preguntas adicionales o ayuda técnica|Complete the prompts as instructed)\b.*$"
# Lines that are one of these go.
LINES_DROPPED = (
    r"(?i)^(?:\d{4}-\d{2}\s+)?(?:Local Control and Accountability Plan|Plan de Rendición de Cuentas con Control Local).+$",
    r"(?i)^(goal|goal #|description|type of goal|state priorities addressed by this goal|action #|title|total funds|contributing|metric #|metric|baseline|year 1 outcome|year 2 outcome|target for year 3 outcome|desired outcome|# de medida|medida|referente|resultado del año|objetivo para resultado del año|goal and|goal and action #|# de meta y acción|necesidades identificadas|medidas para supervisar|effectiveness|provided on an lea-wide or schoolwide basis|scope:?|xlea-wide|xschoolwide|xlimited to.*|xall schools|contributing actions table|annual update table|lcff carryover table)$",
    r"(?i)^Improved Services and Estimated Actual Percentages of Improved Services\.?$",
    r"(?i)^Page \d+ of \d+$",
    r"^\d{4}-\d{2}$",
    r"^[\d\s.$,%()/+-]+$",
)
LINE_MARKERS_DROPPED = (*FUNDING_SUMMARY, "projected percentage to increase", "lcff carryover")
CHUNK_TAIL = r"(?is)\n\s*(?:\d+\s+of\s+\d+\s+)?(?:Local Control and Accountability Plan\s*)?Action\s*\n\s*#\s*(?:●\s*)?(?:Description\s*)?(?:\n|\s)+Total\s*(?:\n|\s)+Funds.*$"

# Fixed values of the quality gate.
QA_TEMPLATE = (
    "local control and accountability plan instructions",
    "lcap instructions",
    "instructions: introduction",
    "requirements and instructions",
    "for additional questions or technical assistance",
    "the lcap template must be completed by all leas",
    "california department of education november",
    "california department of education, july",
)
QA_TABLE = (
    "action # title",
    "action # total funds",
    "contributing actions table",
    "annual update table",
    "lcff carryover",
    "scope unduplicated student group",
    "prior action/service title",
    "local control and accountability plan template action #",
)
QA_SOFT_TABLE = (
    "goal # description",
    "metric #",
    "year 1 outcome",
    "year 2 outcome",
    "target for year 3",
    "planned percentage of improved services",
    "identified need(s) how the action(s)",
    "metric(s) to monitor",
)
QA_BUDGET = (
    "total projected lcff supplemental",
    "projected additional 15 percent",
    "required percentage to increase or improve services",
    "total planned expenditures",
    "total estimated actual expenditures",
)
WANTED_SIGNALS = (
    "chronic absenteeism",
    "attendance",
    "re-engagement",
    "home visit",
    "sarb",
    "family",
    "community schools",
    "implementation challenges",
    "effectiveness",
    "educational partners",
    "equity multiplier",
    "student support",
    "mental health",
    "english learner",
)
HARD_ISSUES = ("template_marker", "budget_marker", "table_marker", "missing_citation_metadata")
MOST_BAD, MOST_TABLE = 0.03, 0.02
QA_MIN_TOKENS, QA_MAX_TOKENS = 45, 1100
OCR_TERMS = ("local", "control", "accountability", "plan", "school", "district", "student", "students", "goal", "action", "parents", "educational")
