"""From a paper's stated fields to a runnable strategy, or to a refusal that says why there is none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from .cells import Strategy
from .guards import GuardError
from .sorts import Rulebook
from .views import Concepts

#: Fixed list: why a strategy is refused.
MISSING_BINDING, OUT_OF_ENUM_WEIGHTING, UNSUPPORTED_TRIM_VARIANT, UNSUPPORTED_COMBINATION = "MISSING_BINDING", "OUT_OF_ENUM_WEIGHTING", "UNSUPPORTED_TRIM_VARIANT", "UNSUPPORTED_COMBINATION"
ASSUMPTION_MISMATCH, REVIEW_REQUIRED, REFUSED_ON_SILENCE, UNSUPPORTED_COMBINER = "ASSUMPTION_MISMATCH", "REVIEW_REQUIRED", "REFUSED_ON_SILENCE", "UNSUPPORTED_COMBINER"

#: What a silent field is taken as; a silent field that isn't here refuses the strategy.
SILENT = {"control": None, "groups": 5, "weighting": "by_size", "signal_lag": 0, "holding_period": 1, "trim": "none", "combiner": "single_leg"}
WEIGHTS = {"by_size": True, "value": True, "value_weighted": True, "equal": False, "equal_weighted": False}
COMBINERS = {"single_leg", "equal_average", "complete_average"}


@dataclass(frozen=True)
class Stated:
    """A field's value and how it is known: STATED, INFERRED, DESIGN, UNKNOWN (silent) or REVIEW (the raters don't agree,
    or a quote isn't found)."""

    value: object = None
    tag: str = "STATED"


@dataclass(frozen=True)
class Refusal:
    code: str
    field: str
    detail: str


def _read(fields: Mapping[str, Stated], name: str, where: str, found: list[Refusal]) -> object:
    field = fields.get(name, Stated(None, "UNKNOWN"))
    if field.tag == "REVIEW":
        found.append(Refusal(REVIEW_REQUIRED, where + name, "the field needs a reviewer"))
    elif field.tag == "UNKNOWN" and name not in SILENT:
        found.append(Refusal(REFUSED_ON_SILENCE, where + name, "the paper is silent and nothing can be assumed"))
    return SILENT.get(name) if field.tag == "UNKNOWN" else field.value


def _leg(fields: Mapping[str, Stated], where: str, concepts: Concepts, found: list[Refusal], **names: str) -> Rulebook | None:
    read = {n: _read(fields, n, where, found) for n in ("signal", "control", "groups", "weighting", "signal_lag", "trim", "holding_period")}
    columns = {}
    for axis in ("signal", "control"):
        if read[axis] is not None:
            try:
                columns[axis] = concepts.column(str(read[axis]))
            except GuardError as error:
                found.append(Refusal(MISSING_BINDING, where + axis, str(error)))
    if read["weighting"] not in WEIGHTS:
        found.append(Refusal(OUT_OF_ENUM_WEIGHTING, where + "weighting", f"{read['weighting']!r} can't be represented"))
    trim = read["trim"] if isinstance(read["trim"], Mapping) else {"method": read["trim"]}
    if trim.get("method") not in ("none", "truncate", "winsorise") or set(trim) - {"method", "low", "high", "percentile"}:
        found.append(Refusal(UNSUPPORTED_TRIM_VARIANT, where + "trim", f"{read['trim']!r} can't be expressed"))
    if read["control"] is not None and (read["holding_period"] or 1) > 1:
        found.append(Refusal(UNSUPPORTED_COMBINATION, where + "control", "a control axis and overlapping holds"))
    if found:
        return None
    try:
        groups = int(read["groups"])
        return Rulebook(
            score=columns["signal"], control=columns.get("control"), groups=groups, by_size=WEIGHTS[read["weighting"]], lag=int(read["signal_lag"]),
            trim=trim["method"], trim_low=trim.get("low"), trim_high=trim.get("high"), trim_percentile=bool(trim.get("percentile", False)), **names,
        )
    except (GuardError, ValueError) as error:
        found.append(Refusal(UNSUPPORTED_COMBINATION, where + "groups", str(error)))
        return None


def adapt(name: str, common: Mapping[str, Stated], legs: Sequence[Mapping[str, Stated]], concepts: Concepts, rules: Sequence[tuple[str, object, str]] = (), **names: str) -> Strategy | tuple[Refusal, ...]:
    """A strategy from its common fields and those of its legs, or all refusals, in the fields' order.

    ``rules`` are (field, value, why) that the engine's assumptions rule out: only a stated value can mismatch.
    ``names`` are a rulebook's names of entity, date, return and size."""
    found: list[Refusal] = []
    for where, fields in [("", common), *((f"legs[{k}].", leg) for k, leg in enumerate(legs))]:
        found += [Refusal(ASSUMPTION_MISMATCH, where + f, why) for f, value, why in rules if f in fields and fields[f].tag == "STATED" and fields[f].value == value]
    combiner = _read(common, "combiner", "", found)
    if combiner not in COMBINERS or (combiner == "single_leg") != (len(legs) == 1):
        found.append(Refusal(UNSUPPORTED_COMBINER, "combiner", f"{combiner!r} of {len(legs)} legs"))
    books = []
    for k, leg in enumerate(legs):
        own: list[Refusal] = []
        books.append(_leg({**common, **leg}, f"legs[{k}].", concepts, own, **names))
        found += own
    if found:
        return tuple(found)
    months = int(_read({**common, **legs[0]}, "holding_period", "", []) or 1)
    return Strategy(name, tuple(books), combiner=combiner, months=months)
