"""Model formulas: `y ~ 1 + x * f + offset(o) + (1 + x | g) + (1 | a/b)`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from varicomp.errors import FormulaError

_NAME = r"[A-Za-z_]\w*"


@dataclass(frozen=True)
class RandomTerm:
    """Random coefficients (an intercept, and perhaps one slope) for each label of the group columns joined by ':'."""

    group: tuple[str, ...]
    slope: str | None = None
    correlated: bool = True

    @property
    def name(self) -> str:
        return ":".join(self.group)


@dataclass(frozen=True)
class Formula:
    response: str
    fixed: tuple[tuple[str, ...], ...]  # each a variable or a pair; the intercept is implied
    offsets: tuple[str, ...]
    random: tuple[RandomTerm, ...]

    @property
    def variables(self) -> list[str]:
        """Columns the model needs, each once."""
        names = [self.response, *(v for t in self.fixed for v in t), *self.offsets]
        names += [g for t in self.random for g in t.group] + [t.slope for t in self.random if t.slope]
        return list(dict.fromkeys(names))


def _random(text: str) -> list[RandomTerm]:
    m = re.fullmatch(rf"\(\s*(1|0\s*\+\s*{_NAME}|(?:1\s*\+\s*)?{_NAME})\s*(\|\|?)\s*({_NAME}(?:\s*[:/]\s*{_NAME})?)\s*\)", text)
    if not m:
        raise FormulaError(f"unsupported random term {text}")
    inner, bar, group = (re.sub(r"\s", "", x) for x in m.groups())
    if inner.startswith("0+"):
        raise FormulaError("a slope without an intercept needs (1 | g) beside it")
    slope = None if inner == "1" else inner.removeprefix("1+")
    if "/" in group:
        if slope:
            raise FormulaError("slopes of nested groups are not supported")
        a, b = group.split("/")
        return [RandomTerm((b, a)), RandomTerm((a,))]
    return [RandomTerm(tuple(group.split(":")), slope, bar == "|")]


def parse(text: str) -> Formula:
    m = re.fullmatch(rf"\s*({_NAME})\s*~(.+)", text, re.S)
    if not m:
        raise FormulaError("a formula is `response ~ terms`")
    right = m[2]
    parts = re.findall(r"\([^()]*\|[^()]*\)", right)
    rest = re.sub(r"\([^()]*\|[^()]*\)", "", right)
    split = {}
    for k, p in enumerate(list(parts)):  # (1 | g) + (0 + x | g) is (1 + x || g)
        if s := re.fullmatch(rf"\(\s*0\s*\+\s*({_NAME})\s*\|\s*({_NAME})\s*\)", p):
            split[k] = (s[1], s[2])
    random = [t for k, p in enumerate(parts) if k not in split for t in _random(p)]
    for slope, group in split.values():
        at = [k for k, t in enumerate(random) if t == RandomTerm((group,))]
        if not at:
            raise FormulaError("(0 + x | g) needs (1 | g) beside it")
        random[at[0]] = RandomTerm((group,), slope, False)
    if not random:
        raise FormulaError("a random term is needed")
    if len({frozenset(t.group) for t in random}) < len(random):
        raise FormulaError("a grouping factor stands twice")
    fixed: list[tuple[str, ...]] = []
    offsets: list[str] = []
    for token in (t.strip() for t in rest.split("+")):
        if token in ("", "1"):
            continue
        if o := re.fullmatch(rf"offset\(\s*({_NAME})\s*\)", token):
            if o[1] in offsets:
                raise FormulaError("an offset stands twice")
            offsets.append(o[1])
        elif re.fullmatch(_NAME, token):
            fixed.append((token,))
        elif s := re.fullmatch(rf"({_NAME})\s*\*\s*({_NAME})", token):
            if s[1] == s[2]:
                raise FormulaError("a product needs two variables")
            fixed += [(s[1],), (s[2],), (s[1], s[2])]
        else:
            raise FormulaError(f"unsupported term {token}")
    for t in random:
        if t.slope and (t.slope,) not in fixed:
            raise FormulaError(f"the random slope {t.slope} is no fixed effect")
    return Formula(m[1], tuple(dict.fromkeys(fixed)), tuple(offsets), tuple(random))
