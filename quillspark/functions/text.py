"""Text functions as columns: white space, quoting, metadata, names and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's regular expressions have it: fixed values.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

#: A note's tags unless a caller names others.
TAGS = ("paper", "converted")


def let(x: Column, made) -> Column:
    """``made(x)`` with ``x`` computed once, however often it occurs there."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, f"(?![!-~])(?:^{WS}+|{WS}+$)", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    # visible ASCII is passed over by one comparison
    return F.trim(F.regexp_replace(x, f"(?![!-~]){WS}+", " "))


def presence(x: Column) -> Column:
    """Collapsed text, null if nothing is left."""
    return F.nullif(collapse(x), F.lit(""))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def json_string(x: Column) -> Column:
    """``x`` as a JSON string literal; letters beyond ASCII stay."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)


def strip_chrome(x: Column, browser: bool = False) -> Column:
    """Model output without its end markers and the page's wrapper; two runtimes have different markers."""
    marks = r"<end_of_utterance>|<\|end_of_text\|>" if browser else r"<end_of_utterance>|<\|im_end\|>"
    return strip(F.regexp_replace(x, marks + "|</?doctag>", ""))


def published(x: Column) -> Column:
    """A PDF date ``D:YYYYMMDD...`` as ``YYYY-MM-DD``; null for anything else."""
    return F.when(x.rlike(r"^D:\d{8}"), F.concat_ws("-", F.substring(x, 3, 4), F.substring(x, 7, 2), F.substring(x, 9, 2)))


def authors(x: Column) -> Column:
    """The single names of a byline."""
    return F.filter(F.transform(F.split(x, ";|, and | and "), strip), lambda a: a != "")


def frontmatter(title, source, author, published_on, created, description, pages, warnings, tags: tuple[str, ...] = TAGS) -> Column:
    """The YAML block at a note's head; what is null or empty is left out."""
    line = lambda key, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(key + ": "), x))
    quoted = lambda key, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(key + ": "), json_string(x)))
    names = F.concat(F.lit("author:\n"), F.array_join(F.transform(authors(author), lambda a: F.concat(F.lit("  - "), json_string(a))), "\n"))
    parts = [F.lit("---"), F.concat(F.lit("title: "), json_string(title)), F.concat(F.lit("source: "), json_string(source)), F.when(F.coalesce(author, F.lit("")) != "", names), line("published", published_on), F.concat(F.lit("created: "), created), quoted("description", description), F.concat(F.lit("pages: "), pages.cast("string")), F.when(warnings > 0, F.concat(F.lit("conversion_warnings: "), warnings.cast("string"))), F.lit("tags:\n" + "".join(f"  - {x}\n" for x in tags) + "---\n")]
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def package_name(title: Column, fallback: Column) -> Column:
    """A folder name from a title, else from the file's name. Reserved characters become ``-``; at most 100 characters."""

    def clean(x: Column) -> Column:
        x = collapse(F.regexp_replace(x, r"[#^\[\]]", " "))
        x = F.regexp_replace(x, "[<>:\"/\\\\|?*\\x00-\\x1F]+", "-")
        x = F.regexp_replace(F.regexp_replace(F.substring(x, 1, 100), r"^\.+", ""), r"[\s-]+$", "")
        return F.nullif(x, F.lit(""))

    return F.coalesce(clean(title), clean(fallback), F.lit("Untitled"))


def retarget_source(md: Column, old: Column, new: Column) -> Column:
    """``source:`` of the front matter points to ``new`` if it is exactly ``old``; the body is never touched."""
    before = F.concat(F.lit("\nsource: "), json_string(old), F.lit("\n"))
    after = F.concat(F.lit("\nsource: "), json_string(new), F.lit("\n"))
    end = F.locate("\n---", F.substr(md, F.lit(4)), 1) + 3
    head, body = F.substr(md, F.lit(1), end), F.substr(md, end + 1)
    return F.when(md.startswith("---\n") & (end > 3) & (F.instr(head, before) > 0), F.concat(F.replace(head, before, after), body)).otherwise(md)


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def media_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(ext == ".png", "image/png").when(ext.isin(".jpg", ".jpeg"), "image/jpeg").when(ext == ".gif", "image/gif").when(ext == ".svg", "image/svg+xml").otherwise("application/octet-stream")


#: What an error message of exhausted memory says, and what the reader is told: fixed values.
OUT_OF_MEMORY = r"(?i)bad_alloc|out of memory|ERROR_CODE: 6\b"
CPU_MEMORY = "The CPU backend ran out of memory on this page. WebAssembly is capped at 4 GB, and pages that split into many tiles exceed it — this document needs a GPU. Other documents may still convert on the CPU."


def slow_device(device: Column) -> Column:
    """Whether a device takes minutes a page; null is no device and isn't."""
    return F.coalesce(device.isin("wasm", "cpu"), F.lit(False))


def explain_failure(message: Column, device: Column, host: str = "the application") -> Column:
    """What a reader is told about an error; a null message is an empty one."""
    m = F.coalesce(message, F.lit(""))
    memory = m.rlike(OUT_OF_MEMORY)
    advice = F.concat(F.lit("Conversion ran out of memory ("), m, F.lit(f"). Try a shorter document, or restart {host} to free memory."))
    return F.when(memory & slow_device(device), CPU_MEMORY).when(memory, advice).otherwise(F.concat(F.lit("Conversion failed: "), m))


def slow_reason(probe_reason: Column, platform: Column, host: str = "the application") -> Column:
    """Why a machine ended up on its CPU, from what the probe of its GPU said (null: nothing); Linux gets a hint."""
    base = F.coalesce(probe_reason, F.lit("No compatible GPU was found."))
    hint = f" On Linux, Chromium still hides WebGPU behind a flag — launching {host} with --enable-features=Vulkan --enable-unsafe-webgpu may enable it."
    return F.when(platform == "linux", F.concat(base, F.lit(hint))).otherwise(base)


def front_fields(md: Column) -> Column:
    """An array of (key, value, items) of the front matter that ``frontmatter`` writes; empty without one. Of a repeated key the last counts.

    ``value`` is null for a list, whose ``items`` are the lines below it; one pair of quotes around either is taken off.
    """
    block = F.regexp_extract(md, r"(?s)\A---\n(.*?)\n---", 1)
    kind = "array<struct<key:string,value:string,items:array<string>>>"
    bare = lambda x: F.regexp_replace(x, r'\A"(.*)"\z', "$1")
    pair, item = r"^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*)$", r"^\s+-\s+(.*)$"

    def step(found, line):
        value = F.regexp_extract(line, pair, 2)
        row = F.struct(F.regexp_extract(line, pair, 1).alias("key"), F.when(value != "", bare(value)).alias("value"), F.array().cast("array<string>").alias("items"))
        last = F.element_at(found, -1)
        longer = F.struct(last["key"].alias("key"), last["value"].alias("value"), F.array_append(last["items"], bare(strip(F.regexp_extract(line, item, 1)))).alias("items"))
        more = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(longer))
        listed = line.rlike(item) & (F.size(found) > 0)
        return F.when(listed & F.coalesce(F.get(found, F.size(found) - 1)["value"].isNull(), F.lit(False)), more).when(line.rlike(pair), F.concat(found, F.array(row))).otherwise(found)

    later = lambda found, x, i: F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["key"] == x["key"])
    return F.aggregate(F.split(block, "\n"), F.array().cast(kind), step, lambda found: F.filter(found, lambda x, i: ~later(found, x, i)))
