"""Results are right only with exactly these, so they stand here as plain text, in one place."""

# Indicator types whose values compare without case; all types compare in lower case.
CASELESS_TYPES = [
    "domain", "email", "url", "hostname", "uri",
    "mal_domain", "mal_url", "phish_url", "c2_domain",
    "compromised_domain", "apt_domain", "hack_domain",
]

# Lower-case aliases and the names that they stand for.
ACTOR_ALIASES = {
    "cozy bear": "APT29",
    "midnight blizzard": "APT29",
    "apt 29": "APT29",
    "apt29": "APT29",
    "lazarus": "Lazarus Group",
    "hidden cobra": "Lazarus Group",
}
MALWARE_ALIASES = {
    "cobalt-strike": "Cobalt Strike",
    "cobeacon": "Cobalt Strike",
    "win.cobalt_strike": "Cobalt Strike",
    "beacon": "Cobalt Strike",
}

# Prefixes of tags that belong to a workflow.
WORKFLOW_PREFIXES = ["Ilamona_", "PIR", "ilamona_", "pir"]

# What a record's tags say if it was exploited, and the score above which it counts as such.
EXPLOIT_TAGS = [
    "observed-in-the-wild:yes",
    "was-zero-day:yes",
    "exploitation-state:weaponized",
    "exploitation-state:exploited",
]
EXPLOIT_SCORE = 0.1

# Patterns for what is pulled out of text.
DATE_PATTERN = r"\d{4}-\d{2}-\d{2}"
TECHNIQUE_PATTERN = r"T\d{4}(?:\.\d{3})?"
IP_PATTERN = r"\b(?:\d{1,3}[\.\[\]]{1,3}){3}\d{1,3}\b"

# How far an association is attributed.
SCOPES = ["direct", "indirect", "suspected", "unknown"]

# Where a row of a feature table comes from.
TIERS = ["OBSERVED", "DERIVED", "LLM_EXTRACTED", "EXTERNAL", "UNVALIDATED"]

# Record type by lower-case file stem; other files are not read.
RECORD_TYPES = {
    "observables": "observable",
    "observable": "observable",
    "campaigns": "campaign",
    "campaign": "campaign",
    "actors": "actor",
    "actor": "actor",
    "malware": "malware",
    "vulnerabilities": "vulnerability",
    "vulnerability": "vulnerability",
    "attack_patterns": "attackpattern",
    "attackpatterns": "attackpattern",
    "attackpattern": "attackpattern",
    "sizing_counts": "_sizing",
    "sizing": "_sizing",
}

# Similarity bands of stories.
MERGE_AT, POSSIBLE_AT = 0.95, 0.82

# Likeness of names of one entity.
FUZZY_AT = 0.88

# The ten bins' edges as a linear space in doubles has them.
BIN_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]
