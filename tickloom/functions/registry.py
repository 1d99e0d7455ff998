"""Features and checks by name. A feature is defined once and computed over a table, for the newest candles, or in a stream."""

from __future__ import annotations

import hashlib
import importlib
import json
import logging
import pkgutil
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, is_dataclass
from typing import Any, get_type_hints

from pyspark.sql import DataFrame

from tickloom.operators.ordered import newest_days, side_by_side
from tickloom.sources.candles import latest as newest

Feature = Callable[[DataFrame, Any], DataFrame]
#: (parameters, state, candle) -> (state, values): a candle is a named tuple, the values are one for each column.
Step = Callable[[Any, tuple, Any], tuple[tuple, tuple]]


@dataclass(frozen=True)
class Definition:
    """A feature. `batch` adds its columns to candles; that alone serves tables.

    parameters: a dataclass of typed fields, which `batch` and `step` are given; without one they get the plain mapping.
    columns: the names of its columns for given parameters. reach: the candles in front of one that its values depend on,
    to double precision; None if all do. A stream needs `step`, with the fields of its `state` and their `start`.
    """

    name: str
    batch: Feature
    parameters: type | None = None
    columns: Callable[[Any], list[str]] | None = None
    role: str | None = None
    reach: Callable[[Any], int] | None = None
    state: str = ""
    start: tuple = ()
    step: Step | None = None


@dataclass(frozen=True)
class Chosen:
    """A feature with its parameters. The postfix tells two parameter sets of one feature apart."""

    definition: Definition
    parameters: Any
    postfix: str = ""

    @property
    def columns(self) -> dict[str, str]:
        """Its columns, and what they are called in results. Empty if the feature doesn't tell."""
        made = self.definition.columns
        return {c: f"{c}{self.postfix}" for c in made(self.parameters)} if made else {}

    def metadata(self) -> dict[str, Any]:
        parameters = asdict(self.parameters) if is_dataclass(self.parameters) else dict(self.parameters)
        return {"name": self.definition.name, "role": self.definition.role, "columns": list(self.columns.values()), "parameters": parameters, "hash": parameter_hash(parameters)}


#: What tells candles apart.
KEY = ["symbol", "timestamp"]
FEATURES: dict[str, Definition] = {}
CHECKS: dict[str, Callable[..., DataFrame]] = {}


def feature(name: str, replace: bool = False, **more: Any) -> Callable[[Feature], Feature]:
    """Register a feature by its batch function; `more` are fields of `Definition`. A name is taken once unless `replace`
    is set."""

    def add(function: Feature) -> Feature:
        if name in FEATURES and not replace:
            raise ValueError(f"feature {name} is registered already")
        FEATURES[name] = Definition(name, function, **more)
        return function

    return add


def discover(package: str) -> list[str]:
    """Import the modules of a package, whose features register themselves; the names of those that are new.

    Modules that can't be imported are logged and skipped, as is a package that isn't there.
    """
    if not package.strip():
        raise ValueError("a package needs a name")
    before = set(FEATURES)
    try:
        found = importlib.import_module(package)
    except ImportError as error:
        logging.getLogger(__name__).error("no package %s: %s", package, error)
        return []
    for module in pkgutil.iter_modules(getattr(found, "__path__", [])):
        try:
            importlib.import_module(f"{package}.{module.name}")
        except ImportError as error:
            logging.getLogger(__name__).warning("module %s.%s is skipped: %s", package, module.name, error)
    return sorted(set(FEATURES) - before)


def typed(kind: type, raw: dict[str, Any]) -> Any:
    """`raw` as the dataclass `kind`. Whole numbers serve as floats; fields it doesn't have, missing ones and values of
    another type are errors, and so is what the dataclass itself refuses."""
    types = get_type_hints(kind)
    given = {k: float(v) if types.get(k) is float and type(v) is int else v for k, v in raw.items()}
    wrong = [k for k, v in given.items() if k not in types or type(v) is not types[k]]
    if wrong:
        raise ValueError(f"{kind.__name__} does not take {', '.join(f'{k}={given[k]!r}' for k in sorted(wrong))}")
    try:
        return kind(**given)
    except TypeError as error:
        raise ValueError(f"{kind.__name__}: {error}") from error


def create(name: str, raw: dict[str, Any] | None = None, postfix: str = "") -> Chosen | None:
    """The feature `name` with checked parameters; None if there is none of that name. A field `type` may repeat the name."""
    if name not in FEATURES:
        return None
    definition, raw = FEATURES[name], dict(raw or {})
    if definition.parameters is None:
        return Chosen(definition, raw, postfix)
    if raw.pop("type", name) != name:
        raise ValueError(f"these are not parameters of {name}")
    return Chosen(definition, typed(definition.parameters, raw), postfix)


def chosen(definitions: Sequence[tuple | Chosen]) -> list[Chosen]:
    """(name, parameters) or (name, parameters, postfix) as features. Unknown names and columns made twice are errors."""
    out, taken = [], set()
    for one in definitions:
        made = one if isinstance(one, Chosen) else create(*one)
        if made is None:
            raise KeyError(f"no feature {one[0]}")
        twice = taken & set(made.columns.values())
        if twice:
            raise ValueError(f"{', '.join(sorted(twice))} would be made twice: give one feature a postfix")
        taken |= set(made.columns.values())
        out.append(made)
    return out


def check(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CHECKS[name] = function
        return function

    return add


def parameter_hash(parameters: dict[str, Any]) -> str:
    return hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()


def parameter_sets(raw: list[dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """Enabled parameter sets by hash; equal ones count once. A set that is no mapping is an error."""
    out: dict[str, dict[str, Any]] = {}
    for one in raw:
        if not isinstance(one, dict):
            raise TypeError(f"a parameter set is a mapping, not {type(one).__name__}")
        if one.get("enabled", True):
            kept = {k: v for k, v in one.items() if k != "enabled"}
            out.setdefault(parameter_hash(kept), kept)
    return out


def supported(names: list[str]) -> dict[str, bool]:
    return {n: n in FEATURES for n in names}


def matching_column(columns: list[str], expected: str, name: str) -> str | None:
    """The column of a feature: the expected name, else the feature's name, else the first that starts with it."""
    for wanted in (expected, name):
        if wanted in columns:
            return wanted
    return next((c for c in columns if c.startswith(f"{name}_")), None)


def compute(candles: DataFrame, definitions: Sequence[tuple | Chosen]) -> DataFrame:
    """Candles with all features; a column of the same name is replaced.

    Several features are computed beside each other from the same candles, and their columns meet by symbol and time in
    one shuffle; chained, each would repeat the plan of those before it several times over. Times are unique in a symbol:
    with several features, of candles of one symbol and time one is kept.
    """
    made = [_alone(candles, one) for one in chosen(definitions)]
    if not made:
        return candles
    if len(made) == 1:
        return made[0][0]
    new = [c for _, columns in made for c in columns]
    narrow = [frame.select(*KEY, *columns) for frame, columns in made]
    out = side_by_side([candles.drop(*new), *narrow], KEY)
    return out.select(*[c for c in candles.columns if c not in new], *new)


def _alone(candles: DataFrame, one: Chosen) -> tuple[DataFrame, list[str]]:
    """Candles with one feature, and the names of its columns."""
    renamed = {c: to for c, to in one.columns.items() if c != to}
    aside = {c: f"_kept_{c}" for c in renamed if c in candles.columns}
    frame = one.definition.batch(candles.withColumnsRenamed(aside), one.parameters)
    frame = frame.drop(*renamed.values()).withColumnsRenamed(renamed).withColumnsRenamed({v: k for k, v in aside.items()})
    return frame, list(one.columns.values()) or [c for c in frame.columns if c not in candles.columns]


def latest(candles: DataFrame, definitions: Sequence[tuple | Chosen]) -> DataFrame:
    """The newest candle of each symbol with all features. Only as many of its last days are computed as the features
    reach back."""
    picked = chosen(definitions)
    reaches = [one.definition.reach(one.parameters) if one.definition.reach else None for one in picked]
    rows = candles if None in reaches else newest_days(candles, ["symbol"], "timestamp", max(reaches, default=0) + 1)
    return newest(compute(rows, picked))


from tickloom.functions import features  # noqa: E402,F401  register the features
