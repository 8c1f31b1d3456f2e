"""SQL fragments for the twins, written for DuckDB's RE2 on their own terms."""

from __future__ import annotations

W = r"[^\p{L}\p{N}]+"


def rx(x: str, pattern: str, replacement: str = " ", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement}', '{flags}')"


def fold(x):
    return f"lower(strip_accents({x}))"


def song_title(x):
    t = rx(fold(x), r"[\(\[\{][^\)\]\}]*[\)\]\}]")
    t = rx(t, r"\s*(feat\.?|featuring|ft\.?|with)\s+.*$")
    tail = (r"\s*[-–—]?\s*(remaster(ed)?(\s*\d{4})?|\d{4}\s*remaster|radio\s*edit|album\s*version|single\s*version"
            r"|mono|stereo|live|explicit|clean|bonus\s*track|remix|edit|version)\s*$")
    t = rx(rx(t, tail, ""), tail, "")
    t = rx(t, r"^\s*(cd\s*\d+\s*[-_. ]*)?(\d{1,2}\s*[-_.]\s*)?([a-d]?\d{1,3})\s*[-_.)\]]+\s*", "")
    t = rx(t, r"[\s\-_.]*(cd|disc|disk)\s*\d{1,2}\s*$", "")
    return f"trim({rx(t, W)})"


def credit_artist(x):
    t = f"trim({rx(f'replace({fold(x)}, {chr(39)}&{chr(39)}, {chr(39)} and {chr(39)})', W)})"
    return f"trim({rx(t, '^the +', '')})"


def compact_title(x):
    t = f"replace(lower({rx(x, r'\(.*?\)|\[.*?\]|\{.*?\}')}), '&', ' and ')"
    t = rx(t, r"^\s*the\s+", "")
    for a, b in (("pts", "parts"), ("pt", "part"), ("vols", "volumes"), ("vol", "volume")):
        t = rx(t, rf"\b{a}\b\.?", b)
    return rx(t, "[^a-z0-9]", "")


def compact_artist(x):
    return rx(f"replace({fold(x)}, '&', 'and')", "[^a-z0-9]", "")


def album_title(x):
    return rx(rx(f"replace(lower({x}), '&', ' and ')", r"[\(\[][^)\]]*[\)\]]"), "[^a-z0-9]+", "")


def release_title(x):
    return f"trim({rx(rx(f'lower({x})', r'\(.*?\)|\[.*?\]'), '[^a-z0-9]+')})"


def alias_name(x):
    return rx(f"strip_accents(replace(lower({x}), 'ß', 'ss'))", "[^a-z0-9]+", "")


CYR = dict(zip("абвгдезийклмнопрстуфхъьыэ", "abvgdeziyklmnoprstufhayye"))
CYR_MANY = [("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sht"), ("ю", "yu"), ("я", "ya"), ("ё", "yo")]


def transliterate(x):
    for a, b in CYR_MANY:
        x = f"replace(replace({x}, '{a}', '{b}'), '{a.upper()}', '{b.capitalize()}')"
    src = "".join(CYR) + "".join(c.upper() for c in CYR)
    dst = "".join(CYR.values()) + "".join(c.upper() for c in CYR.values())
    return f"translate({x}, '{src}', '{dst}')"


def demojibake(x):
    pairs = [(chr(b), bytes([b]).decode("cp1251")) for b in range(0xA0, 0x100)]
    src, dst = "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)
    hits = rf"len(regexp_extract_all({x}, '[À-ÖØ-öø-ÿ]'))"
    letters = rf"len(regexp_extract_all({x}, '\p{{L}}'))"
    return (f"CASE WHEN {hits} >= 3 AND {hits} * 10 >= {letters} * 4 AND NOT regexp_matches({x}, '[^\\x00-\\xff]') "
            f"THEN translate({x}, '{src}', '{dst}') ELSE {x} END")


def script_artist(x):
    s = f"replace(replace(lower({transliterate('(' + demojibake(x) + ')')}), 'ß', 'ss'), '&', ' and ')"
    s = rx(f"strip_accents({s})", r"^\s*the\s+", "")
    s = rx(s, r"^\s*(ms|mrs|miss|mr)\.?\s+(\S)", r"\2")
    return s


def script_key(x):
    s = script_artist(x)
    key = rx(s, "[^a-z0-9]+", "")
    bare = rx(s, r"\s+", "")
    return (f"CASE WHEN {key} = '' AND {bare} <> '' THEN 'u' || array_to_string(list_transform("
            f"string_split({bare}, ''), lambda ch: lower(hex(unicode(ch)))), '') ELSE {key} END")


def search_term(x):
    t = rx(rx(x, r"\(.*?\)|\[.*?\]"), "[‐-―]", "-")
    return f"trim({rx(rx(t, r'[^\p{L}\p{N}_\s&' + chr(39) + '-]'), r'\s+')})"


def words(x):
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def sorted_words(x):
    return f"list_sort({words(x)})"


def except_(a, b):
    return f"list_filter({a}, lambda w: NOT list_contains({b}, w))"


def identity_tokens(title, artist):
    from ledgerline.functions.fixed import IDENTITY_NOISE

    split = lambda c: f"list_filter(string_split_regex(replace(lower({search_term(c)}), '-', ' '), '\\s+'), lambda w: w <> '')"
    noise = "[" + ",".join(f"'{w}'" for w in IDENTITY_NOISE) + "]"
    left = except_(except_(f"list_distinct({split(title)})", split(artist)), noise)
    return rf"list_filter({left}, lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\d+'))"


def path_list(x):
    return f"list_filter(string_split({x}, '/'), lambda p: p <> '')"


def ext(x):
    return rf"lower(regexp_extract({x}, '[^/]\.([^./]*)$', 1))"


def in_list(values):
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


def text_list(x):
    return f"array_to_string({x}, '|')"


def credit_sets(x):
    from ledgerline.functions.fixed import CREDIT_CUTS, CREDIT_NOISE

    raw = rx(x, r"[\(\[][^)\]]*[\)\]]")
    cases = " ".join(
        f"WHEN strpos(lower(_r), ' {w}') > 1 AND NOT regexp_matches(substr(_r, strpos(lower(_r), ' {w}') + {len(w) + 1}, 1), '^\\p{{L}}') "
        f"THEN substr(_r, 1, strpos(lower(_r), ' {w}') - 1)" for w in CREDIT_CUTS)
    noise = "[" + ",".join(f"'{w}'" for w in CREDIT_NOISE) + "]"
    cut = f"list_transform([{raw}], lambda _r: CASE {cases} ELSE _r END)[1]"
    act = (f"array_to_string(list_sort({except_('list_distinct(regexp_extract_all(replace(lower(strip_accents(p)), ' + chr(39) + '&' + chr(39) + ', ' + chr(39) + ' and ' + chr(39) + '), ' + chr(39) + '[a-z0-9]+' + chr(39) + '))', noise)}), ' ')")
    acts = f"list_transform(string_split_regex({cut}, '[&/,;]| and '), lambda p: {act})"
    return f"list_sort(list_distinct(list_filter({acts}, lambda a: a <> '')))"


def variants(x):
    pat = (r"\b(take\s*\d+|alt(?:ernate|\.)?(?:\s+take)?|live|instrumental|remix|rehearsal|demo|karaoke|acappella"
           r"|a\s*cappella|reprise|radio\s+edit|edit|mono|stereo\s+version|interview)\b")
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(lower({x}), '{pat}', 1), lambda m: trim(m))))"


def ancestors(x):
    p = path_list(x)
    return f"list_transform(range(1, len({p})), lambda i: array_to_string(({p})[1:i], '/'))"
