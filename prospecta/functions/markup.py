"""Expressions over html: tokens, attributes, character references. Nothing here leaves the JVM."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospecta.functions.text import bound, strip

#: Elements that hold nothing, and those whose content isn't text.
VOID = ("area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr")
RAW = ("script", "style", "template")

# Inside a tag quotes count only behind an equals sign; a stray one is a character like any other.
_INSIDE = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>]){_INSIDE}>.*?(?:</\1\s*+>|\z)|</?[a-z]{_INSIDE}>|<[!?/][^>]*+(?:>|\z)|(?:[^<]++|<(?![a-z/!?]))++|<"
_ATTRIBUTE = r"""(?is)(?<=[\s"'/])([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?"""
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?"
# What a number from 128 to 159 stands for where it means a byte of Windows' Latin alphabet.
BYTES = {chr(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
NAMES = {name.removesuffix(";"): char for name, char in sorted(html.entities.html5.items())}


def names_of_characters() -> Column:
    """The standard's table of names, as one literal map."""
    return F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a number; the replacement character where there is none."""
    sound = number.isNotNull() & (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    made = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    return F.translate(made, "".join(BYTES), "".join(BYTES.values()))


def _meant(reference: Column) -> Column:
    """What a reference stands for; an unknown name stays, without its semicolon."""
    name = F.regexp_replace(reference, "^&|;$", "")
    short = F.coalesce(*[F.when(name == n, F.lit(c)) for n, c in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\xa0"), ("apos", "'"))])
    decimal, sixteen = F.regexp_extract(name, "^#([0-9]{1,9})$", 1), F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,7})$", 1)
    number = F.when(decimal != "", F.nullif(decimal, F.lit("")).cast("long")).when(sixteen != "", F.conv(sixteen, 16, 10).cast("long"))
    listed = F.element_at(names_of_characters(), name)
    return F.coalesce(short, F.when(F.startswith(name, F.lit("#")), _character(number)), listed, F.concat(F.lit("&"), name))


def decoded(text: Column) -> Column:
    """Every character reference as its character, each once."""

    def replaced(t: Column) -> Column:
        plain, found = F.split(t, _REFERENCE, -1), F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0))
        chars = F.transform(found, _meant)
        both = F.zip_with(plain, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
        return F.array_join(both, "")

    # Most texts have no references at all.
    return bound(text, lambda t: F.when(F.contains(t, F.lit("&")), replaced(t)).otherwise(t))


def tokens(page: Column) -> Column:
    """Tags, comments, texts and elements whose content isn't text, in order; joined they are the page."""
    return F.regexp_extract_all(page, F.lit(TOKEN), F.lit(0))


def text_of(token: Column) -> Column:
    """A token's text without references, or null if it is a tag or comment."""
    return F.when(~token.rlike(r"(?i)\A<[a-z/!?]"), decoded(token))


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"\A</?\s*([a-zA-Z][^\s/>]*)", 1))


def closes_itself(token: Column, name: Column) -> Column:
    return name.rlike(f"^({'|'.join(VOID + RAW)})$") | token.rlike(r"""(?:[\s"']|\A<[^\s/>]+)/>\z""")


def attributes(token: Column, names: tuple[str, ...]) -> Column:
    """A struct of attributes, each the last of its name; '' without a value, null without the attribute."""
    pairs = F.arrays_zip(F.regexp_extract_all(token, F.lit(_ATTRIBUTE), F.lit(1)).alias("n"), F.regexp_extract_all(token, F.lit(_ATTRIBUTE), F.lit(2)).alias("v"))
    bare = lambda v: decoded(F.regexp_replace(v, r"""(?s)\A(["'])(.*)\1\z""", "$2"))
    known = F.transform(F.filter(pairs, lambda p: F.lower(p["n"]).isin(*names)), lambda p: F.struct(F.lower(p["n"]).alias("n"), bare(p["v"]).alias("v")))
    of = lambda ps, name: F.try_element_at(F.filter(ps, lambda p: p["n"] == name), F.lit(-1))["v"]
    read = bound(known, lambda ps: F.struct(*[of(ps, n).alias(n) for n in names]))
    # Most tags have none; those aren't read at all.
    return F.when(F.contains(token, F.lit("=")) | token.rlike(r"\s"), read).otherwise(F.struct(*[F.lit(None).cast("string").alias(n) for n in names]))


def joined(texts: Column, between: str) -> Column:
    """Texts without white space around them, the empty ones left out."""
    return F.array_join(F.filter(F.transform(texts, lambda t: strip(t)), lambda t: t != ""), between)


def one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))
