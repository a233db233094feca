"""Names, URIs and CURIEs: rules for the driver, and the same rules as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from urllib.parse import quote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = re.compile(r"[ _\-]+")
# Grammars of RFC 3986 and of CURIEs. URI: a scheme, a colon and legal characters.
URI_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^\s/?#<>\"{}|\\^`]*)?[^\s?#<>\"{}|\\^`]*(?:\?[^\s#<>\"{}|\\^`]*)?(?:#[^\s#<>\"{}|\\^`]*)?$"
CURIE_PATTERN = r"^(?:[A-Za-z_][A-Za-z0-9_.\-]*)?:[^\s<>\"{}|\\^`:/][^\s<>\"{}|\\^`]*$|^[A-Za-z_][A-Za-z0-9_.\-]*:$"
NCNAME_PATTERN = r"^[A-Za-z_À-�][A-Za-z0-9_.\-·À-�]*$"


def de_space(name: str) -> str:
    return name.replace(" ", "_")


def snake_case(name: str) -> str:
    """Words parted by underscores: at separators, before a capital after a small letter, and before the
    last capital of an acronym that goes on in small letters."""
    parted = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    parted = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", parted)
    parted = re.sub(r"[ _\-]+(?=[^A-Za-z]|$)", "", parted)
    return _SEPARATORS.sub("_", parted).lower()


def pascal_case(name: str) -> str:
    """Words joined with capitals; without separators, a leading acronym becomes a capitalised word."""
    if _SEPARATORS.search(name):
        return "".join(w[:1].upper() + w[1:].lower() for w in _SEPARATORS.split(name) if w)
    acronym = re.match(r"[A-Z]{2,}(?=[A-Z][a-z])|[A-Z]{2,}$", name)
    if acronym:
        head = acronym[0]
        return head[0] + head[1:].lower() + name[len(head) :]
    return name[:1].upper() + name[1:]


def camel_case(name: str) -> str:
    found = pascal_case(name)
    return found[:1].lower() + found[1:]


def uri_encode(name: str) -> str:
    """Form encoding: space as +, and * . - _ kept."""
    return quote_plus(name, safe="*.-_").replace("~", "%7E")


def namespace(reference: str) -> str:
    return reference if reference.endswith(("/", "?", "#")) else reference + "/"


def is_uri(text: str) -> bool:
    return text.startswith("urn:") or "://" in text


class UnknownPrefix(ValueError):
    pass


def expand(text: str, prefixes: Mapping[str, str]) -> str:
    """A URI as it is; a CURIE with its prefix's namespace; a text without a colon unchanged."""
    if is_uri(text) or ":" not in text:
        return text
    prefix, local = text.split(":", 1)
    if prefix not in prefixes:
        raise UnknownPrefix(prefix)
    return namespace(prefixes[prefix]) + local


def compact(uri: str, prefixes: Mapping[str, str]) -> str | None:
    """The CURIE of a URI split after its fragment mark, query mark or last slash; None for an unknown base."""
    for mark in "#?/":
        at = uri.rfind(mark)
        if at >= 0:
            base, local = uri[: at + 1], uri[at + 1 :]
            return next((f"{p}:{local}" for p, r in prefixes.items() if namespace(r) == base), None)
    return None


def valid_uri(text: str) -> bool:
    return re.match(URI_PATTERN, text) is not None


def valid_curie(text: str) -> bool:
    return re.match(CURIE_PATTERN, text) is not None or re.match(r"^[^\s:<>\"{}|\\^`]*$", text) is not None


# -- the same over columns


def snake_case_col(name: Column) -> Column:
    parted = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    parted = F.regexp_replace(parted, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    parted = F.regexp_replace(parted, r"[ _\-]+(?=[^A-Za-z]|$)", "")
    return F.lower(F.regexp_replace(parted, r"[ _\-]+", "_"))


def pascal_case_col(name: Column) -> Column:
    words = F.filter(F.split(name, r"[ _\-]+"), lambda w: w != "")
    rest = lambda w, n: F.substring(w, n, F.length(w))
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(rest(w, F.lit(2))))), "")
    acronym = F.regexp_extract(name, r"^([A-Z]{2,}(?=[A-Z][a-z])|[A-Z]{2,}$)", 1)
    folded = F.concat(F.substring(acronym, 1, 1), F.lower(rest(acronym, F.lit(2))), rest(name, F.length(acronym) + 1))
    single = F.concat(F.upper(F.substring(name, 1, 1)), rest(name, F.lit(2)))
    return F.when(name.rlike(r"[ _\-]"), joined).when(acronym != "", folded).otherwise(single)


def camel_case_col(name: Column) -> Column:
    found = pascal_case_col(name)
    return F.concat(F.lower(F.substring(found, 1, 1)), F.substring(found, F.lit(2), F.length(found)))


def expand_col(text: Column, prefixes: Mapping[str, str], strict: bool = True) -> Column:
    """CURIE expansion; an unknown prefix is an error, or null if not strict."""
    spaces = F.create_map(*[x for p, r in sorted(prefixes.items()) for x in (F.lit(p), F.lit(namespace(r)))]) if prefixes else F.create_map()
    prefix, local = F.substring_index(text, ":", 1), F.regexp_replace(text, r"^[^:]*:", "")
    found = F.try_element_at(spaces, prefix)
    missing = F.raise_error(F.concat(F.lit("unknown prefix: "), prefix)) if strict else F.lit(None).cast("string")
    curie = F.when(found.isNotNull(), F.concat(found, local)).otherwise(missing)
    return F.when(text.startswith("urn:") | text.contains("://") | ~text.contains(":"), text).otherwise(curie)


def compact_col(uri: Column, prefixes: Mapping[str, str]) -> Column:
    """The CURIE of a URI, null for an unknown base."""
    by_space = {namespace(r): p for p, r in reversed(sorted(prefixes.items()))}
    spaces = F.create_map(*[x for s, p in sorted(by_space.items()) for x in (F.lit(s), F.lit(p))])
    pattern = F.when(uri.contains("#"), F.lit("#")).when(uri.contains("?"), F.lit("?")).otherwise(F.lit("/"))
    local = F.element_at(F.split(uri, F.concat(F.lit("["), pattern, F.lit("]"))), -1)
    base = F.substring(uri, F.lit(1), F.length(uri) - F.length(local))
    prefix = F.try_element_at(spaces, base)
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit(":"), local))


def synthetic_uri_col(space: Column, name: Column) -> Column:
    return F.concat(space, F.url_encode(name))


_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


#: Kinds of characters that are replaced one kind at a time in a text; texts of more are written character by character.
_KINDS = 64


def _by_code(code: Column) -> Column:
    return F.when(code <= "0000FFFF", F.concat(F.lit("\\u"), F.substring(code, 5, 4))).otherwise(F.concat(F.lit("\\U"), code))


def _replaced(text: Column, odd: str, whole: Column) -> Column:
    """text with each character that ``odd`` matches by its code; ``whole`` for a text of many kinds of them."""
    kinds = F.array_distinct(F.regexp_extract_all(text, F.lit(odd), 0))
    each = F.aggregate(kinds, text, lambda acc, c: F.replace(acc, c, _by_code(F.hex(F.encode(c, "UTF-32")))))
    return F.when(F.size(kinds) <= _KINDS, each).otherwise(whole)


def _coded(text: Column, plain: Callable[[Column], Column], short: Mapping[str, str]) -> Column:
    """text with each character as it is, as its short escape, or as \\u or \\U and its code."""
    codes = F.regexp_extract_all(F.hex(F.encode(text, "UTF-32")), F.lit("(.{8})"), 1)

    def one(code: Column) -> Column:
        found = F.when(plain(code), F.decode(F.unhex(F.substring(code, 7, 2)), "UTF-8"))
        for raw, escaped in short.items():
            found = found.when(code == f"{ord(raw):08X}", escaped)
        return found.otherwise(_by_code(code))

    return F.array_join(F.transform(codes, one), "")


def ntriples_string(text: Column) -> Column:
    """A string for N-Triples: backslash, quote, line ends and tab by their escapes, all else beyond ASCII by its code."""
    simple = text
    for raw, escaped in _SHORT.items():
        simple = F.replace(simple, F.lit(raw), F.lit(escaped))
    plain = lambda code: code.between("00000020", "0000007E") & ~code.isin("00000022", "0000005C")
    odd = r"[^\x20-\x7E\n\r\t]"
    return F.when(text.rlike(odd), _replaced(simple, odd, _coded(text, plain, _SHORT))).otherwise(simple)


def ntriples_iri(text: Column) -> Column:
    """An IRI for N-Triples: what it may not hold, and all beyond ASCII, by its code."""
    odd = [f"{ord(c):08X}" for c in '<>"{}|^`\\']
    plain = lambda code: code.between("00000021", "0000007E") & ~code.isin(odd)
    return F.when(text.rlike(r"[^\x21-\x7E]|[<>\"{}|^`\\\\]"), _coded(text, plain, {})).otherwise(text)


_ODD_STRING, _ODD_IRI = re.compile(r'[^\x20-\x7E]|["\\]'), re.compile(r'[^\x21-\x7E]|[<>"{}|^`\\]')


def _code(found: re.Match) -> str:
    code = ord(found[0])
    return f"\\u{code:04X}" if code < 0x10000 else f"\\U{code:08X}"


def ntriples_escape(text: str, iri: bool = False) -> str:
    """The same on the driver, with everything beyond ASCII as \\u and \\U escapes."""
    if iri:
        return _ODD_IRI.sub(_code, text)
    return _ODD_STRING.sub(lambda m: _SHORT.get(m[0]) or _code(m), text)
