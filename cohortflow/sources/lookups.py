"""Fixed values of the study: items, factors, action times, category maps.

Everything in this file is a constant that results depend on; the code that uses it is elsewhere.
"""

# Carbohydrate content in g/mL by product and its item ids (None: unknown).
NUTRITION_FACTORS = (
    ("Beneprotein", (225970, 229583), 0.0),
    ("Boost Glucose Control", (227979,), 0.067510549),
    ("Enlive", (228355,), 0.189873418),
    ("Ensure", (226875, 225937), 0.139240506),
    ("Ensure Plus", (226877,), 0.202531646),
    ("Fiber Supplement", (229574,), None),
    ("Fibersource HN", (227698, 227699, 227696, 227695), 0.156118143),
    ("Glucerna", (228356, 228359), 0.11),
    ("Glucerna 1.2", (229013,), 0.113924050632911),
    ("Glucerna 1.5", (229295,), 0.132911392405063),
    ("Impact", (226023, 226020, 226022, 221207), 0.132),
    ("Impact with Fiber", (226027, 225928), 0.132),
    ("Isosource 1.5", (228131, 228132, 228133, 228134, 228135), 0.167088608),
    ("Jevity 1.2", (229010,), 0.169620253164557),
    ("Jevity 1.5", (229011,), 0.215611814345992),
    ("Nepro", (228348, 228351), 0.147272727),
    ("NovaSource Renal", (227973, 227974, 227975), 0.184810127),
    ("Nutren 2.0", (226019, 226016, 226017, 227518, 225931), 0.196),
    ("Nutren Pulmonary", (226882, 226881, 226880), 0.10),
    ("Nutren Renal", (226031, 226028, 226030, 221036), 0.184810127),
    ("Osmolite 1.5", (229297,), 0.20337552742616),
    ("Peptamen 1.5", (226039, 226036, 226038, 225930), 0.188),
    ("Peptamen Bariatric", (228383,), 0.078),
    ("Probalance", (225929,), None),
    ("Promote", (229009,), 0.131223628691983),
    ("Promote with Fiber", (229014,), 0.139240506329114),
    ("Pulmocare", (228360, 228361, 228363), 0.105485232),
    ("Replete", (226047, 226044, 226046, 225935), 0.112),
    ("Replete with Fiber", (226051, 226048, 226049, 226050, 225936), 0.124),
    ("Two Cal HN", (228364, 228367), 0.219),
    ("Vital 1.5", (229012,), 0.186497890295359),
    ("Vital High Protein", (229296,), 0.112658227848101),
    ("Vivonex", (226059, 225934), 0.00256),
)

# Hours added to the end of an insulin dose; every listed product starts half an hour late.
INSULIN_ACTION_HOURS = (
    ("Insulin - Regular", 4.0),
    ("Insulin - Humalog", 4.0),
    ("Insulin - Novolog", 2.0),
    ("Insulin - NPH", 10.0),
    ("Insulin - 70/30", 10.0),
    ("Insulin - Humalog 75/25", 10.0),
    ("Insulin - U500", 10.0),
    ("Insulin - Glargine", 12.0),
)
INSULIN_ONSET_HOURS = 0.5

# Grams of dextrose per mL, and the hours a push or bolus is spread over.
DEXTROSE_CONCENTRATION = (
    ("Dextrose 5%", 0.05),
    ("Dextrose 10%", 0.10),
    ("Dextrose 20%", 0.20),
    ("Dextrose 40%", 0.40),
    ("Dextrose 50%", 0.50),
)
DEXTROSE_PARENTERAL = "Dextrose PN"
BOLUS_HOURS = 0.1667
CONTINUOUS_ORDERS = ("Continuous Med", "Continuous IV")
PUSH_ORDERS = ("Drug Push", "Bolus")

# Glucose item, preference among duplicates, upper limit in mg/dL, sample type.
GLUCOSE_ITEMS = (
    (220621, 1, 1000.0, "Lab (serum)"),
    (226537, 2, 1000.0, "Lab (whole blood)"),
    (225664, 3, 500.0, "Fingerstick"),
)
SEDATION_ITEM = 228096

# Feeding categories.
ORAL = "Fluids/Intake"
ENTERAL = "Nutrition - Enteral"
PARENTERAL = "Nutrition - Parenteral"
SUPPLEMENTS = "Nutrition - Supplements"
ORAL_LABEL = "PO Intake"
FEEDING_CLASSES = (
    ("Oral intake only", ORAL),
    ("Enteral feeding only", ENTERAL),
    ("Parenteral feeding only", PARENTERAL),
)
COMBINED = "Combined"

# Ventilation record to class.
VENTILATION_CLASSES = {
    "invasive": ("InvasiveVent", "Tracheostomy"),
    "noninvasive": ("NonInvasiveVent", "HFNC", "SupplementalOxygen"),
    "none": ("None",),
}
NO_RECORD = "NaN"

# First part of the recorded ethnicity to group.
RACE_GROUPS = {
    "Hispanic": ("HISPANIC/LATINO", "SOUTH AMERICAN", "HISPANIC OR LATINO"),
    "Black": ("BLACK/AFRICAN AMERICAN", "BLACK/CAPE VERDEAN", "BLACK/AFRICAN", "BLACK/CARIBBEAN ISLAND"),
    "White": ("PORTUGUESE", "WHITE"),
    "Asian": ("ASIAN",),
    "Unknown": ("UNABLE TO OBTAIN", "UNKNOWN", "PATIENT DECLINED TO ANSWER"),
    "Other": ("OTHER", "AMERICAN INDIAN/ALASKA NATIVE", "AMERICAN INDIAN OR ALASKA NATIVE",
              "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER", "MULTIPLE RACE/ETHNICITY"),
}

# Admission type to urgency.
ADMISSION_GROUPS = {
    "Emergency": ("AMBULATORY OBSERVATION", "DIRECT EMER.", "URGENT", "EW EMER.", "DIRECT OBSERVATION",
                  "EU OBSERVATION", "OBSERVATION ADMIT"),
    "Elective": ("ELECTIVE", "SURGICAL SAME DAY ADMISSION"),
}
DEATH_DISCHARGES = ("HOSPICE", "DIED")

# Diabetes codes are the four-character codes under these stems.
DIABETES_STEMS = ("250", "E10", "E11", "E12", "E13", "E14")
DIABETES_PREFIXES = tuple(f"{stem}{digit}" for stem in DIABETES_STEMS for digit in range(10))

# Glucocorticoids, study medication, systemic routes, hours of action after the stop.
GLUCOCORTICOIDS = ("dexamethasone", "cortisone", "prednisolone", "prednisone")
STUDY_WORDS = ("study", "placebo")
SYSTEMIC_ROUTES = ("IV", "PO", "ORAL", "PO/NG")
GLUCOCORTICOID_HOURS = 24.0

# Cut points.
AGE_BREAKS = (float("-inf"), 55.0, 65.0, 75.0, float("inf"))
DEXTROSE_BREAKS = (float("-inf"), 0.0, 0.5, 2.0, float("inf"))
INSULIN_BREAKS = (float("-inf"), 0.0, 1.5, 3.0, float("inf"))
CARBOHYDRATE_BREAKS = (float("-inf"), 4.5, 6.5, 8.5, float("inf"))
CARBOHYDRATE_LABELS = ("≤ 4.5 grams/hour", "4.5-6.5 grams/hour", "6.5-8.5 grams/hour", "≥ 8.5 grams/hour")
