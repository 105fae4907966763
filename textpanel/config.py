"""Settings of a run, as one immutable object, and word lists whose values are fixed."""

from __future__ import annotations

from dataclasses import dataclass

# Seed bigrams of the geoeconomic domain.
SEEDS = (
    "trade war", "trade tensions", "trade dispute", "trade barriers", "import tariffs", "retaliatory tariffs", "tariff increase",
    "economic sanctions", "financial sanctions", "trade sanctions", "export controls", "export restrictions", "entity list", "sanctions regime",
    "geopolitical risk", "geopolitical tensions", "geopolitical uncertainty", "national security", "foreign policy", "political risk", "regional conflict",
    "supply disruption", "supply security", "import dependence", "near shoring", "critical infrastructure",
    "rare earth", "critical minerals", "critical materials", "semiconductor supply", "chip shortage",
    "technology transfer", "technology restrictions", "economic decoupling", "dual use", "export ban", "critical technologies",
    "energy security", "energy independence", "gas supply", "oil supply",
    "investment screening", "industrial policy", "capital controls", "currency manipulation", "protectionist measures", "import substitution",
    "cyber attack", "cyber security", "data sovereignty",
)

# Words of risk and uncertainty.
RISK_WORDS = (
    "risk", "risks", "risky", "uncertain", "uncertainty", "uncertainties", "threat", "threats", "threaten", "threatened", "threatening", "danger", "dangerous",
    "concern", "concerns", "concerned", "worry", "worries", "worried", "fear", "fears", "fearful", "volatile", "volatility", "unpredictable", "exposure", "exposed",
    "vulnerability", "vulnerable",
)

#: Stop words by default: the commonest English function words. A longer list is a parameter (word_list, or Spark's StopWordsRemover).
STOPWORDS = tuple("a an and any are as at be been but by can could did do does for from had has have he her his how if in into is it its may more most must no not now of on or our out over she so some still such than that the their them then there these they this those to under up was we were what when which while who will with would you your".split())

# Patterns of legal boilerplate in transcripts (case is ignored).
SAFE_HARBOR = (
    r"private securities litigation reform act|forward[- ]looking statements|safe harbor|actual results (may|could|might|should) differ|"
    r"factors that could cause|refer to our (sec )?filings|form 10-k|cautionary statement"
)
SAFE_HARBOR_ENDS = (r"with that,? (said|let me (turn|hand)|I'll turn|now)", r"and now", r"I will now turn", r"let's begin", r"moving to", r"turning to")
SAFE_HARBOR_SENTENCE = (
    r"private securities litigation|forward[- ]looking|safe.harbor|safe.harbour|actual results (may|could|might|should) differ|"
    r"factors that could cause|refer to our (sec )?filings|form 10[- ]?k|cautionary statement"
)
# Stage directions in transcripts.
MARKERS = (
    r"[\[\(]\s*(speaking\s+)?(in\s+)?(foreign language|foreign languages|non[- ]?english|interpreted|interpretation|inaudible|indiscernible|"
    r"audio gap|technical difficult(y|ies)|operator instructions|background noise|no audio|music playing|call to order)\s*[\]\)]|"
    r"\bforeign language(s)?\b|\blanguage interpreted\b|\bspeaking foreign\b"
)

# Upper bounds (exclusive) of the divisions of the industry code.
SIC_DIVISIONS = (
    (1000, "Agriculture"), (1500, "Mining"), (1800, "Construction"), (4000, "Manufacturing"), (5000, "Transport/Utilities"), (5200, "Wholesale"), (6000, "Retail"),
    (6800, "Finance"), (9000, "Services"), (None, "Public Admin."),
)


@dataclass(frozen=True)
class Config:
    """Every lever of the pipeline; pass it on, nothing reads the environment."""

    boilerplate: str = "off"  # off, once, iter
    markers: bool = True
    sentence_safe_harbor: bool = False
    min_chars: int = 5
    seeds: tuple[str, ...] = SEEDS
    stopwords: tuple[str, ...] = STOPWORDS
    risk_words: tuple[str, ...] = RISK_WORDS
    p_threshold: float = 0.8
    sample_size: int = 100_000
    model_vocab: int = 10_000
    min_docfreq: int = 5
    dictionary_top: int = 9_600
    folds: int = 5
    search: bool = True  # grids by folds and a SVM; else pinned parameters and a logistic regression
    seed: int = 42
