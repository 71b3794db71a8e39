"""LaTeX repair as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, escape_xml, let, strip


def fix(tex: Column) -> Column:
    """Balanced braces, an equation number as a tag, and an aligned environment where there are alignment marks."""
    marked = lambda t: ((F.instr(t, "\\\\") > 0) | t.rlike(r"(?<!\\)&")) & (F.instr(t, "\\begin") == 0)
    aligned = lambda t: F.when(marked(t), F.concat(F.lit("\\begin{aligned}"), t, F.lit("\\end{aligned}"))).otherwise(t)
    tagged = lambda t: F.regexp_replace(t, rf"&{WS}*&{WS}*\({WS}*(\d+){WS}*\){WS}*\z", r"\\tag{$1}")

    def balanced(t: Column) -> Column:
        more = F.regexp_count(t, F.lit(r"(?<!\\)\{")) - F.regexp_count(t, F.lit(r"(?<!\\)\}"))
        return let(more, lambda m: F.concat(F.repeat(F.lit("{"), F.greatest(-m, F.lit(0))), t, F.repeat(F.lit("}"), F.greatest(m, F.lit(0)))))

    return let(let(strip(tex), lambda t: tagged(balanced(t))), aligned)


def truncated(tex: Column) -> Column:
    """Parentheses or brackets that aren't closed, or closed too often."""
    t = F.regexp_replace(tex, r"\\[(){}\[\]]", "")
    n = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (n("(") != n(")")) | (n("[") != n("]"))


def clean(md: Column) -> Column:
    """Every ``$$...$$`` of a text repaired.

    The text is cut at ``$$``; parts at odd places are formulas, an unpaired last one isn't. An empty part can't be a
    formula, so texts with four dollars in a row are cut at the pattern itself.
    """
    some = lambda plain: F.transform(plain, lambda x, i: F.when((i % 2 == 1) & (i < F.size(plain) - 1), fix(x)).otherwise(x))
    fixed = F.array_join(let(F.split(md, r"\$\$", -1), some), "$$")
    # marks that no text has fence each formula that the lazy pattern finds
    fenced = F.regexp_replace(md, r"(?s)\$\$(.+?)\$\$", "\uE000$1\uE001")
    odd = F.transform(F.split(fenced, "(?=\uE000)|(?<=\uE001)", -1), lambda x: F.when(x.startswith("\uE000") & x.endswith("\uE001"), F.concat(F.lit("$$"), fix(F.substr(x, F.lit(2), F.length(x) - 2)), F.lit("$$"))).otherwise(x))
    return F.when(F.instr(md, "$$$") == 0, fixed).otherwise(F.array_join(odd, ""))


def trivial_xhtml(tex: Column) -> Column:
    """Maths that needs no renderer, as sub- and superscripts; null for all else."""
    # fixed patterns: a script alone, a base with one or two scripts, a short name
    script = rf"^{WS}*([_^])\{{?([^{{}}$\\]{{1,12}})\}}?{WS}*$"
    tag = lambda mark, x: F.when(mark == "^", F.concat(F.lit("<sup>"), escape_xml(x), F.lit("</sup>"))).otherwise(F.concat(F.lit("<sub>"), escape_xml(x), F.lit("</sub>")))
    one = r"([_^])(?:\{([^{}$\\]{1,16})\}|([A-Za-z0-9]))"
    full = rf"^([A-Za-z][A-Za-z0-9]{{0,7}}){one}(?:{one})?$"

    def scripted(dense: Column) -> Column:
        g = lambda k: F.regexp_extract(dense, full, k)
        first, second = F.concat(g(3), g(4)), F.concat(g(6), g(7))
        based = F.concat(F.lit("<em>"), g(1), F.lit("</em>"), tag(g(2), first), F.when(g(5) != "", tag(g(5), second)).otherwise(""))
        return F.when(dense.rlike(full) & (g(2) != g(5)), based)

    ident = rf"^{WS}*([A-Za-z][A-Za-z0-9]{{0,3}}){WS}*$"
    return F.when(tex.rlike(script), tag(F.regexp_extract(tex, script, 1), F.regexp_extract(tex, script, 2))).when(tex.rlike(ident), F.concat(F.lit("<em>"), F.regexp_extract(tex, ident, 1), F.lit("</em>"))).otherwise(let(F.regexp_replace(tex, f"{WS}+", ""), scripted))
