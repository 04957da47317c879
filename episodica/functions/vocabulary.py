"""Fixed values.

Texts, patterns and column lists that must be exactly these for results to be
right. They are data of the domain, kept together and in natural order.
"""

ADMISSION_SENTINEL = "SEM DATAHORA INTERNAÇÃO"
DISCHARGE_SENTINEL = "SEM DATAHORAALTA"

DEATH = "Óbito"
TRANSFER = "Transferência"
ADMINISTRATIVE_CLOSURE = "Encerramento administrativo"

# Discharge reasons after which an episode cannot start a recurrence.
INELIGIBLE_REASONS = (DEATH, TRANSFER)
# Discharge reasons listed by the exclusion report.
REPORTED_REASONS = (TRANSFER, DEATH, ADMINISTRATIVE_CLOSURE)

# Years typed wrongly at admission, with the years to add.
YEAR_SHIFTS = ((2004, 20), (2013, 10))

# One admission whose text was typed wrongly: subject, text, corrected time.
ADMISSION_OVERRIDES = (
    (
        "504ac34ff10ba0c69bd09d503dfe942d7576b8a843f0152b9b5e67d92bcffa65",
        "12/11/2022 07:08:00",
        "2025-11-12 07:08:00",
    ),
)

# Gap in days between discharge and next admission that counts as recurrence.
RECURRENCE_DAYS = (2, 30)
RAW_RECURRENCE_DAYS = (0, 30)

# Diagnosis codes that signal an acute event, by prefix and by two-digit range in chapter O.
ACUTE_ICD_PATTERN = (
    "^(A0|A39|A40|A41|A49|I21|I22|I6[0-4]|J1[2-8]|J80|J96|K65|N10|N12|N17|N30|N39|R57|T8[0-8]|P95)"
)
ACUTE_OBSTETRIC_RANGES = ((0, 8), (10, 29), (42, 46), (60, 75), (85, 99))
DELIVERY_ICD_PREFIXES = ("O80", "O82")

# Procedure texts that signal an acute event, and those of routine care, by fragment.
ACUTE_PROCEDURES = (
    "INTERCORR",
    "COMPLICA",
    "ATENDIMENTO DE URGENC",
    "SINDROME CORONARIANA AGUDA",
    "INSUFICIENCIA RENAL AGUDA",
    "CRISES EPILEPTICAS",
    "PNEUMON",
    "PIELONEFR",
    "SEPSE",
    "ACIDENTE VASCULAR CEREBRAL",
    "INFART",
    "HEMORR",
    "INFECC",
)
ROUTINE_PROCEDURES = (
    "PARTO",
    "CESARI",
    "QUIMIOTERAP",
    "RADIOTERAP",
    "ANTINEOPLAS",
    "HEMODIAL",
    "DIALISE",
    "DIÁLISE",
    "REABILIT",
)
TRANSPLANT = "TRANSPLANTE DE"
POST_TRANSPLANT = ("POS-TRANSPLANTE", "PÓS-TRANSPLANTE")

# Fragments of the admission character.
TRANSFER_FRAGMENT = "TRANSFER"
URGENT_FRAGMENTS = ("URGEN", "EMERGEN")
ELECTIVE_FRAGMENTS = ("ELETIV", "PROGRAM")

# Labels of the reports.
PLANNED = "Potencialmente planejada"
UNPLANNED = "Potencialmente não planejada"
UNDETERMINED = "Indeterminada"
NOT_STATED = "Não informado"
NOT_INFORMED = "Not informed"
MISSING_DISCHARGE_REASON = "Alta ausente"
OTHER_REASON = "Outro"
OUTCOME_LABELS = {0: "No unplanned readmission", 1: "Unplanned readmission"}

# Specialty groups by name fragment, first match wins.
SPECIALTY_GROUPS = (
    ("Nefrologia ou diálise", ("NEFRO", "DIAL")),
    ("Oncologia ou hematologia", ("ONCO", "HEMATO")),
    ("Reabilitação", ("REABIL",)),
    ("Obstetrícia ou ginecologia", ("OBSTET", "GINECO")),
    ("Neonatologia", ("NEONAT",)),
    ("Saúde mental", ("PSIQUI", "MENTAL")),
)
OTHER_SPECIALTIES = "Outras especialidades"

# Stay buckets: inclusive upper bound in days and label; beyond the last one the open label.
STAY_BUCKETS = ((1, "0-1 days"), (3, "2-3 days"), (7, "4-7 days"), (14, "8-14 days"))
STAY_BUCKET_OPEN = "15+ days"

AUDIT_STAY_BUCKETS = (
    (-1, "Negative"),
    (0, "0 days"),
    (1, "1 day"),
    (3, "2-3 days"),
    (7, "4-7 days"),
    (14, "8-14 days"),
    (30, "15-30 days"),
    (90, "31-90 days"),
    (180, "91-180 days"),
    (365, "181-365 days"),
    (1000, "366-1000 days"),
)
AUDIT_STAY_OPEN = "1000+ days"
AUDIT_STAY_MISSING = "Missing discharge"

OVERLAP_HOUR_BUCKETS = ((6, "0-6 hours"), (24, "7-24 hours"))
OVERLAP_DAY_BUCKETS = ((3, "2-3 days"), (7, "4-7 days"))
OVERLAP_OPEN = "8+ days"

# The six extracts and their file names.
EXTRACT_FILES = {
    "appointments": "1_consultas_gercon.csv",
    "regulated_exams": "2_exames_regulados_gercon.csv",
    "non_regulated_exams": "3_exames_nao_regulados_gercon.csv",
    "requests": "4_solicitacoes_gerpac.csv",
    "hospitalizations": "5_internacoes_gerint.csv",
    "billing": "6_faturamento_gerint.csv",
}
