"""Ordered replace-all masks as chained native ``regexp_replace`` expressions."""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temploom.errors import InvalidConfig, RegexCompileError


def java_pattern(pattern: str) -> str:
    """Unicode-aware pattern with ``$`` as the end of text and ``.`` stopping at ``\\n`` only, in Java's dialect."""
    if re.search(r"\(\?[a-z]*U", pattern):
        raise RegexCompileError("the swap-greed flag U has no Java counterpart")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "$":
            c = r"\z"
        elif pattern.startswith("(?P<", i):
            c, i = "(?<", i + 3
        out.append(c)
        i += 1
    return "(?Ud)" + "".join(out)


def _groups(pattern: str) -> tuple[int, set[str]]:
    """Number of capturing groups and the names among them."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", bare)), set(re.findall(r"\(\?P?<([A-Za-z_]\w*)>", bare))


def java_replacement(placeholder: str, pattern: str) -> str:
    """Expand ``$1``/``$name``/``${name}``/``$$`` as references; unknown groups give the empty string."""
    count, names = _groups(pattern)

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        if name is None:
            return r"\$" if m[0] == "$" else "\\\\"
        if name.isdigit():
            return f"${int(name)}" if int(name) <= count else ""
        return f"${{{name}}}" if name in names else ""

    return re.sub(r"\$\$|\$\{([^}]*)\}|\$(\w+)|\$|\\", one, placeholder)


@dataclass(frozen=True)
class Mask:
    """A regular expression and the placeholder that replaces each of its matches.

    needs: a literal that every match contains; a text without it isn't searched.
    """

    pattern: str
    placeholder: str
    needs: str | None = None

    def apply(self, col: Column) -> Column:
        return F.regexp_replace(col, F.lit(java_pattern(self.pattern)), F.lit(java_replacement(self.placeholder, self.pattern)))

    def validate(self, spark: SparkSession) -> "Mask":
        """Compile the pattern on the JVM; raises RegexCompileError."""
        try:
            spark._jvm.java.util.regex.Pattern.compile(java_pattern(self.pattern))
        except RegexCompileError:
            raise
        except Exception as e:
            raise RegexCompileError(f"mask pattern {self.pattern!r}: {e}") from e
        return self


_HEX = "[0-9a-fA-F]"
BUILTIN_MASKS: dict[str, Mask] = {
    "uuid": Mask(rf"\b{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}\b", "<uuid>", "-"),
    "hex32": Mask(rf"\b{_HEX}{{32}}\b", "<hex32>"),
    "email": Mask(r"\b[A-Za-z0-9_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<email>", "@"),
    "ipv4": Mask(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ipv4>", "."),
    "jwt": Mask(r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "<jwt>", "eyJ"),
}


def parse_mask_list(spec: str) -> tuple[Mask, ...]:
    """``"uuid, ipv4"`` to masks; blanks are ignored, unknown names are an error."""
    names = [x.strip() for x in spec.split(",") if x.strip()]
    if unknown := [x for x in names if x not in BUILTIN_MASKS]:
        raise InvalidConfig(f"unknown mask {unknown[0]!r}; known: {', '.join(BUILTIN_MASKS)}")
    return tuple(BUILTIN_MASKS[x] for x in names)


def with_masks(df: DataFrame, name: str, masks: tuple[Mask, ...]) -> DataFrame:
    """Column ``name`` masked, mask by mask, so that each is tried only on texts that hold what it needs."""
    for m in masks:
        done = m.apply(F.col(name))
        df = df.withColumn(name, done if m.needs is None else F.when(F.contains(F.col(name), F.lit(m.needs)), done).otherwise(F.col(name)))
    return df


def apply_masks(col: Column, masks: tuple[Mask, ...]) -> Column:
    return reduce(lambda c, m: m.apply(c), masks, col)
