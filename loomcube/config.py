"""Parameters of a run: parsing, validation and conversion between text, JSON and dataclasses."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_bool(value: str | bool) -> bool:
    """Texts that begin with ``y`` or ``t`` in either case are true."""
    return value if isinstance(value, bool) else value.strip().lower()[:1] in {"y", "t"}


def unique_names(names: list[str]) -> list[str]:
    """Repeated abbreviations get the suffixes ``_1``, ``_2`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}_{n}" if n else name)
    return out


def parse_categories(text: str) -> list[list[str]]:
    """White space separates categories, commas the roots of one category."""
    return [[root for root in part.split(",") if root] for part in text.split()]


def sniff(key: str, text: str) -> object:
    """The value of a parameter line: a flag if the key says include, a list if it has blanks, a number, or text."""
    text = text.strip()
    if "include" in key:
        return parse_bool(text)
    if " " in text:
        return text.split()
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None if text in {"", "None"} else text


def text_to_parameters(text: str) -> dict[str, object]:
    """``key: value`` lines; a repeated key collects its values in a list."""
    out: dict[str, object] = {}
    repeated: set[str] = set()
    for line in text.splitlines():
        if ":" not in line:
            continue
        key, _, value = line.partition(":")
        key = key.strip()
        value = sniff(key, value)
        if key not in out:
            out[key] = value
        else:
            out[key] = [*(out[key] if key in repeated else [out[key]]), value]
            repeated.add(key)
    return out


def parameters_to_text(parameters: dict[str, object]) -> str:
    """The inverse of :func:`text_to_parameters`."""
    lines = []
    for key, value in parameters.items():
        many = value if isinstance(value, list) and value and isinstance(value[0], list) else [value]
        lines += [f"{key}: {' '.join(map(str, v)) if isinstance(v, list) else v}" for v in many]
    return "\n".join(lines) + "\n"


@dataclass(frozen=True)
class Preprocessing:
    """Categories, their roots, and how the entity set is widened."""

    abbreviations: tuple[str, ...] = ()
    categories: tuple[tuple[str, ...], ...] = ()
    terms: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    include_ppi: bool = False
    ppi_hops: int = 1
    ppi_score: float = 0.99
    include_pathways: bool = False
    pathway_count: int = 4
    pathway_share: float = 0.5
    pathway_mode: str = "or"
    include_regulators: bool = False
    strict_prefix: bool = True

    def problems(self, known_codes: set[str], known_terms: set[str]) -> list[str]:
        """What is wrong with these parameters, empty if nothing."""
        out = []
        if len(self.abbreviations) != len(self.categories):
            out.append(f"{len(self.abbreviations)} abbreviations for {len(self.categories)} categories")
        out += [f"unknown tree number {r}" for c in self.categories for r in c if r not in known_codes]
        out += [f"unknown term {t}" for t in self.terms if t not in known_terms]
        if self.pathway_mode not in {"or", "and"}:
            out.append(f"pathway_mode is {self.pathway_mode}, not or or and")
        return out


@dataclass(frozen=True)
class TextMining:
    """Which documents and sections are counted."""

    first_year: int = 1800
    last_year: int = 2022
    sections: str = "full_text_no_methods"
    vary_case: bool = True
    include_full_text: bool = False
    include_label_imputation: bool = False
    check_synonyms: bool = False
    rerun_scoring: bool = False


@dataclass(frozen=True)
class Analysis:
    """Which scores are analysed and the threshold of significance."""

    z_threshold: float = 3.0
    analyze_all_entities: bool = False
    analyze_core_entities: bool = True
    merge_entities: bool = True
    thresholds: tuple[float, ...] = (1, 2, 3, 5, 10)


@dataclass(frozen=True)
class KnowledgeGraph:
    """Which edge lists go into the graph and how score edges are weighted."""

    include_tree: bool = True
    include_ppi: bool = True
    include_pathways: bool = True
    include_regulators: bool = True
    weight: str = "raw"


@dataclass(frozen=True)
class Parameters:
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    text_mining: TextMining = field(default_factory=TextMining)
    analysis: Analysis = field(default_factory=Analysis)
    graph: KnowledgeGraph = field(default_factory=KnowledgeGraph)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def from_text(kind: type, text: str):
    """A parameter dataclass from ``key: value`` lines; missing keys keep their defaults, unknown ones are errors."""
    given = text_to_parameters(text)
    known = {f for f in kind.__dataclass_fields__}
    if extra := sorted(set(given) - known):
        raise ValueError(f"unknown parameters: {', '.join(extra)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def valid_date(text: str) -> bool:
    """Whether the text is a date written ``YYYY-MM-DD``."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return False
    year, month, day = map(int, text.split("-"))
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    days = [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return 1 <= month <= 12 and 1 <= day <= days[month - 1]


def unknown_values(given: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Values that validation rejects: those of ``given`` that ``known`` lacks."""
    return given.select(column).distinct().join(known.select(column), column, "left_anti").orderBy(F.col(column))
