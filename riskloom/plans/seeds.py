"""Constants of the domain and the seed dimensions of the driver tables."""

from __future__ import annotations

# Taxonomy keywords, taxonomy weights, overview and detail keyword sets, acronyms,
# impact texts and extra aliases.
TAXONOMY_KEYWORDS = {
    "Regulatory / Compliance": [
        "regulator", "regulatory", "compliance", "breach", "fine", "investigation",
        "misconduct claim", "authority", "sanction", "lawsuit",
    ],
    "Financial Integrity": [
        "fraud", "money laundering", "market manipulation", "mis-selling", "embezzlement",
        "ponzi", "insider trading",
    ],
    "Customer Harm": [
        "poor treatment", "unfair", "discrimination", "complaint", "customer harm",
        "mistreatment", "abuse", "harm claim",
    ],
    "Data / Cyber": [
        "breach claim", "breach", "leak", "ransomware", "insecure", "data theft", "phishing",
    ],
    "Operational Resilience": [
        "outage", "service failure", "disruption", "downtime", "incident", "degraded service",
        "systemic disruption",
    ],
    "Executive / Employee Misconduct": [
        "leadership scandal", "harassment", "unethical", "executive", "employee misconduct",
        "workplace", "toxic culture",
    ],
    "Misinformation / Manipulation": [
        "misinformation", "disinformation", "coordinated", "bot", "astroturf", "manipulation",
        "influence campaign",
    ],
}
TAXONOMY_WEIGHTS = {
    "Regulatory / Compliance": 9.0,
    "Financial Integrity": 4.0,
    "Customer Harm": 10.0,
    "Data / Cyber": 5.0,
    "Operational Resilience": 7.0,
    "Executive / Employee Misconduct": 9.0,
    "Misinformation / Manipulation": 5.0,
}
OVERVIEW_KEYWORDS = {
    "Regulatory / Compliance": [
        "regulator", "regulatory", "compliance", "breach", "fine", "investigation",
        "misconduct claim", "authority", "sanction",
    ],
    "Financial Integrity": [
        "fraud", "money laundering", "market manipulation", "mis-selling", "embezzlement",
        "ponzi", "insider trading",
    ],
    "Customer Harm": [
        "poor treatment", "unfair", "discrimination", "complaint", "customer harm",
        "mistreatment", "abuse",
    ],
    "Data / Cyber": [
        "breach", "leak", "ransomware", "cyber", "insecure", "data theft", "phishing",
    ],
    "Operational Resilience": [
        "outage", "service failure", "disruption", "downtime", "incident", "degraded service",
    ],
    "Executive / Employee Misconduct": [
        "leadership scandal", "harassment", "unethical", "executive", "employee misconduct",
        "workplace", "toxic culture",
    ],
    "Misinformation / Manipulation": [
        "misinformation", "disinformation", "coordinated", "bot", "astroturf", "manipulation",
        "influence campaign",
    ],
}
DETAIL_KEYWORDS = {
    "Regulatory / Compliance": [
        "regulator", "compliance", "fine", "investigation", "breach", "sanction",
    ],
    "Financial Integrity": [
        "fraud", "money laundering", "market manipulation", "mis-selling", "loss",
    ],
    "Customer Harm": ["complaint", "unfair", "discrimination", "harm", "mistreatment"],
    "Data / Cyber": ["cyber", "breach", "leak", "ransomware", "phishing"],
    "Operational Resilience": [
        "outage", "service failure", "downtime", "disruption", "incident",
    ],
    "Executive / Employee Misconduct": [
        "scandal", "harassment", "unethical", "misconduct", "leadership",
    ],
    "Misinformation / Manipulation": [
        "misinformation", "disinformation", "bot", "coordinated", "manipulation",
    ],
}
ACRONYMS = {
    "Regulatory / Compliance": "RC",
    "Financial Integrity": "FI",
    "Customer Harm": "CH",
    "Data / Cyber": "DC",
    "Operational Resilience": "OR",
    "Executive / Employee Misconduct": "EEM",
    "Misinformation / Manipulation": "MM",
}
IMPACT = {
    "Regulatory / Compliance": "higher regulatory scrutiny, legal exposure, and potential penalties.",
    "Financial Integrity": "investor confidence erosion and possible legal or enforcement action.",
    "Customer Harm": "brand trust decline and sustained customer attrition risk.",
    "Data / Cyber": "reputation damage, customer trust loss, and remediation cost escalation.",
    "Operational Resilience": "service reliability concerns that can weaken customer confidence.",
    "Executive / Employee Misconduct": "governance credibility pressure and leadership risk.",
    "Misinformation / Manipulation": "narrative control risk and amplification of reputational damage.",
}
EXTRA_ALIASES = {
    "astrazeneca": ["AZN", "$AZN", "#AZN", "Astra Zeneca", "Astrazenica", "Astra Zenica"],
    "pfizer": ["PFE", "$PFE", "#PFE", "Phizer", "Pizer"],
    "eliquis": [],
    "johnson_johnson": ["J&J", "JNJ", "$JNJ", "#JNJ", "Johnson and Johnson", "J and J"],
    "merck": ["MRK", "$MRK", "#MRK", "Merck & Co", "Merk"],
    "keytruda": [],
    "bristol_myers_squibb": [
        "BMS", "$BMS", "#BMS", "Bristol Myers", "Bristol-Myers", "Bristol Meyers Squibb",
        "Bristol Myers Squib",
    ],
    "moderna": ["MRNA", "$MRNA", "#MRNA", "Modern a"],
    "revlimid": [],
    "gardasil": ["Gardasil 9", "Gardasil9", "Gardasil-9", "Gardisil"],
    "eli_lilly": ["EliLilly", "Eli Liliy", "Lilly"],
    "gsk": ["GlaxoSmithKline", "Glaxo Smith Kline", "Glaxo"],
    "amgen": ["AMGN", "$AMGN", "#AMGN"],
    "opdivo": [],
    "hpv": ["Human Papillomavirus", "Human Papilloma Virus"],
    "novo_nordisk": ["NVO", "$NVO", "#NVO", "NovoNordisk", "Novo Nordik"],
    "xarelto": ["Xeralto"],
    "biontech": ["BNTX", "$BNTX", "#BNTX", "Bio Tech"],
    "cidara_therapeutics": ["Cidara", "CDTX", "$CDTX", "#CDTX", "Cidarra"],
}

# Seed dimensions for the driver tables: words that occur in the documents.
DRIVER_ENTITIES = [
    ("thanedble", "Thanedble", "therhean"),
    ("tiontion", "Tiontion", "theaeati"),
    ("thtionnt", "Thtionnt", ""),
    ("onanshat", "Onanshat", "ofonrereer"),
    ("thtithly", "Thtithly", "thinerha"),
    ("enmentai", "Enmentai", "ofenedat"),
    ("thedones", "Thedones", "toingheth"),
    ("licensse", "Licensse", "worthlesss"),
]
DRIVER_EXTRA_ALIASES = {"thtionnt": ["thintion"]}
DRIVER_LEXICON = [
    ("trash", -3.0), ("clown", -2.0), ("idiot", -3.0), ("scum", -3.0), ("worthless", -3.0),
    ("moron", -3.0), ("pathetic", -2.5), ("loser", -2.0), ("disgusting", -3.0), ("stupid", -2.5),
    ("thin", -1.5), ("onhe", -1.0), ("thintion", -1.0), ("ernd", 1.0), ("ined", 1.0), ("that", 0.5),
]
DRIVER_KEYWORDS = {
    "Customer Harm": ["trash", "worthless", "pathetic"],
    "Executive / Employee Misconduct": ["scum", "idiot"],
    "Operational Resilience": ["onanshat"],
    "Regulatory / Compliance": ["license"],
}


def with_driver_words(keywords: dict[str, list[str]]) -> dict[str, list[str]]:
    """A keyword set extended by the words that the driver documents hold."""
    return {label: words + DRIVER_KEYWORDS.get(label, []) for label, words in keywords.items()}
