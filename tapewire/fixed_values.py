"""Values that have to be exactly these for results to be right.

Everything here is a fixed value: word lists, lookup tables and thresholds, in
their natural order.  The category keyword dictionary is not among them, it is
data and always comes in as a parameter (``sources.read_category_json`` or
``sources.read_category_commands``).
"""

from __future__ import annotations

# Words that mark financial risk, one substring test each.
RISK_WORDS = """
volatility turbulence fluctuation instability gyration swing oscillation erratic whipsaw
choppy unpredictable crash collapse meltdown plunge plummet drawdown dive tumble
correction nosedive freefall selloff capitulation rout bloodbath bankruptcy default
insolvency restructuring liquidation writedown impairment bailout delisting chapter-11
foreclosure distress receivership fraud scandal lawsuit litigation investigation penalty
fine sanction violation breach misconduct misreporting restatement
accounting-irregularities leverage margin-call counterparty-risk liquidity-crunch
black-swan tail-risk contagion flash-crash short-squeeze systemic-risk credit-crunch
bubble overheated recession depression slowdown contraction inflation stagflation
hyperinflation deflation unemployment austerity deficit downgrade devaluation regulation
restriction intervention ban prohibition antitrust breakup oversight compliance
supervision audit subpoena war conflict tension sanctions embargo tariff trade-war
dispute crisis unrest revolution coup nationalism npl non-performing-loan credit-default
credit-downgrade stress-test funding-gap capital-shortfall liquidity-risk
reserve-requirement haircut bank-run deposit-flight credit-freeze panic fear uncertainty
doubt anxiety pessimism distrust nervousness jittery caution bearish negative-outlook
""".split()

# Used when the risk word file cannot be read.
DEFAULT_RISK_WORDS = ["risk", "loss", "default", "bankruptcy", "crash"]

# Deal-making words.
MA_WORDS = ["m&a", "merger", "acquisition", "deal", "strategic", "expansion", "growth"]

# Commodity words.
COMMODITY_WORDS = [
    "output", "capacity", "margin", "commodity", "smelter", "cut", "price", "supply", "demand",
]

# The 14 category letters and the label text a zero-shot model is given.
CATEGORY_LABELS = {
    "A": "earnings, quarterly results, fund commentary and financial performance",
    "B": "analyst ratings, price targets and stock recommendations",
    "C": "mergers, acquisitions, deals and takeovers",
    "D": "regulatory, legal, compliance and government investigations",
    "E": "economic data, central banks, interest rates and monetary policy",
    "F": "corporate actions, executive changes and leadership",
    "G": "market trends, sector analysis and investment flows",
    "H": "ipo, new listings, public offerings and stock debuts",
    "I": "product launches, clinical trials, drug approvals and innovation",
    "J": "general business, company news and industry updates",
    "K": "commodities, energy, oil, gas and raw materials",
    "L": "esg, sustainability, climate and corporate responsibility",
    "M": "macro, geopolitics, trade wars, sanctions and political events",
    "N": "technology trends, ai, semiconductors and digital disruption",
}
CATEGORY_LETTERS = list(CATEGORY_LABELS)
DEFAULT_CATEGORY = "J"

# Display names; every other letter shows as OTHER_CATEGORY_NAME.
CATEGORY_NAMES = {
    "A": "Earnings",
    "B": "Analyst Ratings & Recommendations",
    "C": "Mergers, Acquisitions & Deals",
    "D": "Regulatory & Legal Developments",
    "E": "Economic Data & Federal Reserve",
    "F": "Corporate Actions & Leadership",
    "G": "Market Trends & Sector Analysis",
    "H": "IPO & New Listings",
    "I": "Product Launches & Innovation",
    "J": "General Business & Industry News",
}
OTHER_CATEGORY_NAME = "General News"

# Base risk of a risk level, any other level 0.1.
RISK_BASE = {"high_risk": 0.9, "moderate_risk": 0.7, "medium_risk": 0.5}
LOW_RISK_BASE = 0.1

# Score of an impact label, any other label 0.
IMPACT_SCORES = {
    "BULLISH": 2.0,
    "RISKY BULLISH": 1.5,
    "POSITIVE": 1.0,
    "SLIGHTLY POSITIVE": 0.5,
    "NEUTRAL": 0.0,
    "SLIGHTLY NEGATIVE": -0.5,
    "NEGATIVE": -1.0,
    "BEARISH": -2.0,
    "MODERATE RISK": -1.5,
    "HIGH RISK": -3.0,
}

# What null becomes before scoring.
SCORING_DEFAULTS = {
    "sentiment": 0.0,
    "confidence": 0.0,
    "content": "",
    "description": "",
    "title": "",
    "risk_score": 0.0,
    "impact_assessment": "NEUTRAL",
    "content_quality": "unknown",
    "symbol": "",
}

# Field boosts of the article search and of the similar-article search.
SEARCH_BOOSTS = {
    "title": 3.0, "description": 2.0, "content": 1.0,
    "key_phrases": 2.0, "summary": 2.0, "source": 1.0,
}
SIMILAR_BOOSTS = {"key_phrases": 2.0, "title": 1.0, "description": 1.0}

# The pipelines whose throughput and latency are reported.
PIPELINES = ["extract", "transform", "backend", "baseline"]
