"""Values that results depend on."""

# Tables and texts that must be as published for right results.
DRUG_TARGETS = {"Ampicillin": "ftsI", "Ciprofloxacin": "gyrA,parC", "Trimethoprim": "folA"}
INTRINSIC = "gyra gyrb parc pare fola folp glpt uhpt alr ddl rpob rpsl mgrb cpxr ef-tu h-ns".split()
DRUG_CLASS = {"Ampicillin": "Beta-lactam (aminopenicillin)", "Ciprofloxacin": "Fluoroquinolone", "Trimethoprim": "Folate-pathway antagonist (DHFR inhibitor)"}
DRUG_LOCUS = {"Ampicillin": "ftsI", "Ciprofloxacin": "gyrA", "Trimethoprim": "folA"}
STATE_LABEL = {"likely_to_fail": "Likely to fail", "likely_to_work": "Likely to work", "no_call": "No-call", "not_applicable": "No-call"}
DISCLAIMER = "This is a research prototype. All results must be confirmed with standard laboratory testing."
OOD_REASON = "This genome's resistance-gene profile is unlike anything in the training data, so the model's confidence cannot be trusted."
CAUSAL_FAMILIES = {
    "Ampicillin": ["CTX-M", "TEM", "SHV", "OXA-1", "OXA-10", "OXA-2", "OXA-48", "CMY/CMY-2/CFE/LAT", "CMY-1/MOX", "DHA/MOR", "KPC", "NDM", "VIM", "IMP", "GES", "VEB", "CARB/PSE"],
    "Ciprofloxacin": ["AAC-Ib-cr"],
    "Trimethoprim": ["dhfrI", "dhfrV", "dfrA", "dfrD", "dfrA12"],
}
# Curated resistance genes of each drug.
KNOWN_GENES = {
    "Ampicillin": "blaTEM blaTEM-1 blaTEM-12 blaTEM-30 blaTEMp_C32T blaTEMp_G162T blaCTX-M-1 blaCTX-M-14 blaCTX-M-15 blaCTX-M-27 blaCTX-M-55 blaSHV-1 blaSHV-12 blaOXA-1 blaOXA-10 blaCMY-2 blaCMY-42 blaKPC-2 blaKPC-3 blaNDM-1 blaNDM-5 blaNDM-7 ampC_T-32A ftsI_I336IKYRI ftsI_N337NYRIN".split(),
    "Ciprofloxacin": "gyrA_S83L gyrA_S83A gyrA_D87N gyrA_D87G parC_S80I parC_E84V parC_E84G parC_A56T parE_S458A parE_E460K parE_I355T parE_I529L parE_L416F qnrA1 qnrB6 qnrB19 qnrS1 aac(6')-Ib-cr5".split(),
    "Trimethoprim": "dfrA1 dfrA5 dfrA7 dfrA8 dfrA12 dfrA14 dfrA17 dfrA27".split(),
}
# Patterns of symbols and the one feature that each stands for; the first that matches counts.
BRIDGE = [
    (r"^(bla)?ctx-m", "CTX-M"),
    (r"^(bla)?tem", "TEM"),
    (r"^(bla)?shv", "SHV"),
    (r"^(bla)?oxa-?10", "OXA-10"),
    (r"^(bla)?oxa-?48", "OXA-48"),
    (r"^(bla)?oxa-?2$", "OXA-2"),
    (r"^(bla)?oxa", "OXA-1"),
    (r"^(bla)?cmy", "CMY/CMY-2/CFE/LAT"),
    (r"^(bla)?(dha|mor)", "DHA/MOR"),
    (r"^(bla)?kpc", "KPC"),
    (r"^(bla)?ndm", "NDM"),
    (r"^(bla)?vim", "VIM"),
    (r"^(bla)?imp", "IMP"),
    (r"^(bla)?ges", "GES"),
    (r"^(bla)?veb", "VEB"),
    (r"^(bla)?(carb|pse)", "CARB/PSE"),
    (r"^ampc", "ampC"),
    (r"^sul", "Sulfonamide"),
    (r"^(dfr|dhfr)", "dhfrI"),
    (r"^tet", "Tet"),
    (r"^(mph|mrx)", "Mph"),
    (r"^erm", "Erm"),
    (r"^ere", "EreB"),
    (r"^mef", "Mef"),
    (r"^msr", "Msr"),
    (r"^lnu", "Lnu/Lnu"),
    (r"^catb", "CatB"),
    (r"^cat", "CatA1/CatA4"),
    (r"^cml", "CmlA"),
    (r"^flor", "FloR"),
    (r"^aac\(6'\)-ib-cr", "AAC-Ib-cr"),
    (r"^aac", "AAC-II,III,IV,VI,VIII,IX,X"),
    (r"^(aad|ant)", "ANT-Ia"),
    (r"^(aph\(3''\)|aph\(6\)|str[ab])", "APH-Ic/APH-Id"),
    (r"^aph", "APH-I"),
    (r"^(qnr|gyr|par)", "Quinolone"),
    (r"^fosa", "fosA"),
    (r"^mcr", "colistin"),
    (r"^qac", "QacE"),
]
INTRINSIC_COLUMNS = ["BlaEC"]
# Tokens of a text that name a resistance gene (any case).
GENE_TOKEN = r"(?i)\b(?:bla[A-Za-z0-9\-]+|(?:CTX-M|NDM|KPC|OXA|VIM|IMP|SHV|TEM|CMY|GES|VEB|DHA|PSE|CARB|MOX)(?:-?\d+)?|(?:aac|aad|aph|ant|sul|dfr|dhfr|tet|mph|erm|qnr|cat|mcr|fos|arr|aadA|strA|strB)[A-Za-z0-9()'\-]*|gyrA|parC|parE|gyrB)\b"
CURATED_COUNT, MAX_DRIVERS = "_curated_count", 3
CURATED_NOTE = "Curated resistance determinant for this drug."
STATISTICAL_NOTE = "Statistical association in training data only — not a confirmed mechanism."
SPECIES, LAB_EVIDENCE = "Escherichia coli", "Laboratory Method"
CALLS = ["likely_to_work", "likely_to_fail", "no_call", "not_applicable"]
EVIDENCE = ["known_gene_or_mutation", "statistical_association", "no_known_signal"]
GATES = ["present", "absent", "unknown"]
SEEDS = list(range(8))
PAGE_LIMIT, BATCH_IDS, TRIES = 25_000, 100, 4
FEW_CLUSTERS = 10
NO_CALL_LOW, NO_CALL_HIGH = 0.30, 0.70
MASH_K, MASH_THRESHOLD, SKETCH = 21, 0.02, 256
OOD_PERCENTILE, OOD_FLOOR = 0.99, 1.0
LOGIT_EPS, LR_C = 1e-6, 0.1
TEST_FRACTION, CALIBRATION_FRACTION = 0.20, 0.15
MIN_CALIBRATION_ROWS, OOF_FOLDS = 40, 5
MIN_GENOME_BP = 1_000_000
