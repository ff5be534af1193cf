"""What a search asks for, checked before any data is touched."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from datetime import datetime, timezone

# Sort names and the column they stand for; "relevance" is the match score.
SORT_COLUMNS = {
    "date": "publishedAt", "publishedAt": "publishedAt", "published_date": "publishedAt",
    "relevance": "score", "sentiment": "sentiment", "risk": "risk_adj",
    "risk_score": "risk_adj", "confidence": "confidence",
}
# Sort names of the user interface.
UI_SORTS = {
    "newest": ("date", "desc"), "oldest": ("date", "asc"), "relevant": ("relevance", "desc"),
    "risk": ("risk_score", "desc"), "sentiment": ("sentiment", "desc"),
    "confidence": ("confidence", "desc"),
}
SENTIMENTS = ("all", "positive", "negative", "neutral")
DAY_MS = 86_400_000


def parse_date_ms(text: str) -> int:
    """ISO date or date-time to epoch milliseconds; without a zone it is UTC."""
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return round(moment.timestamp() * 1000)


def _pair(value) -> tuple[float, float] | None:
    if value in (None, ""):
        return None
    low, high = json.loads(value) if isinstance(value, str) else value
    return float(low), float(high)


def _set(value) -> str | None:
    """Missing, blank and ``all`` mean no filter."""
    text = "" if value is None else str(value).strip()
    return None if text in ("", "all") else text


@dataclass(frozen=True)
class SearchSpec:
    q: str | None = None
    sentiment: str | None = None
    category: str | None = None
    source: str | None = None
    risk_level: str | None = None
    symbol: str | None = None
    impact: str | None = None
    risk_score: tuple[float, float] | None = None
    confidence: tuple[float, float] | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    sort_by: str = "date"
    sort_order: str = "desc"
    page: int = 1
    page_size: int = 20
    bands: str = "server"

    @classmethod
    def from_params(cls, params: dict, end_inclusive_day: bool = False) -> SearchSpec:
        """Read request parameters under any of their accepted names."""

        def first(*names):
            return next((params[n] for n in names if params.get(n) not in (None, "")), None)

        ui = params.get("sortBy")
        sort_by, sort_order = UI_SORTS.get(ui, (params.get("sort_by") or "publishedAt", None))
        start, end = _set(first("dateStart", "start_date")), _set(first("dateEnd", "end_date"))
        end_ms = None if end is None else parse_date_ms(end)
        if end_ms is not None and end_inclusive_day and len(end) == 10:
            end_ms += DAY_MS - 1
        risk = _pair(first("riskScore"))
        low, high = first("risk_score_min", "riskScoreMin"), first("risk_score_max", "riskScoreMax")
        if risk is None and (low is not None or high is not None):
            risk = (float(low) if low is not None else 0.0, float(high) if high is not None else 1.0)
        return cls(
            q=_set(first("search", "q")),
            sentiment=_set(params.get("sentiment")),
            category=_set(params.get("category")),
            source=_set(params.get("source")),
            risk_level=_set(first("riskLevel", "risk_level")),
            symbol=_set(first("ticker", "symbol")),
            impact=_set(params.get("impact_assessment")),
            risk_score=risk,
            confidence=_pair(first("confidence")),
            start_ms=None if start is None else parse_date_ms(start),
            end_ms=end_ms,
            sort_by=sort_by,
            sort_order="asc" if ui == "oldest" else (params.get("sort_order") or sort_order or "desc"),
            page=int(params.get("page") or 1),
            page_size=int(first("limit", "page_size") or 20),
        ).validate()

    def validate(self) -> SearchSpec:
        def check(ok: bool, message: str) -> None:
            if not ok:
                raise ValueError(message)

        check(self.q is None or len(self.q) <= 500, "search text has more than 500 characters")
        check(self.sentiment is None or self.sentiment in SENTIMENTS, "unknown sentiment")
        check(self.bands in ("server", "client"), "unknown band set")
        check(1 <= self.page <= 1000, "page must lie in 1..1000")
        check(1 <= self.page_size <= 100, "page size must lie in 1..100")
        for pair, top, name in ((self.risk_score, 1, "risk score"), (self.confidence, 100, "confidence")):
            check(pair is None or 0 <= pair[0] <= pair[1] <= top, f"{name} must be min <= max in 0..{top}")
        return self

    @property
    def sort_column(self) -> str:
        return SORT_COLUMNS.get(self.sort_by, "publishedAt")

    @property
    def ascending(self) -> bool:
        return self.sort_order == "asc"

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size

    def with_page(self, page: int) -> SearchSpec:
        return replace(self, page=page).validate()


def check_range(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}")
    return value


def check_symbol(symbol: str) -> str:
    text = symbol.strip().upper()
    if not 1 <= len(text) <= 20:
        raise ValueError("symbol must have 1 to 20 characters")
    return text
