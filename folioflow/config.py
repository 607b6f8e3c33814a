"""Parameters of the corpus: nothing in the library is tied to one site."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Site:
    origin: str = "https://docs.example.com"
    root: str = "/docs"
    text_suffix: str = ".txt"
    agent: str = "folioflow-bot"
    #: Sections shown at the root of the navigation tree, in order: (path segment, label).
    sections: tuple[tuple[str, str], ...] = (("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish"))
    #: Words of a path segment that are written in capitals in a label.
    acronyms: frozenset[str] = field(default_factory=lambda: frozenset({"api", "cli", "css", "html", "http", "id", "json", "sdk", "sql", "ui", "url"}))


SITE = Site()

#: Hours by which the budget's calendar day is ahead of UTC.
BUDGET_OFFSET_HOURS = 8
SEARCH_LIMIT = 20
