"""DuckDB oracle fragments for description features.

Rule patterns are shared data; RE2 differences are handled here: Arabic words
next to ``\\b`` get explicit letter-class boundaries, ``\\d`` counts use
``\\p{Nd}``.
"""

from propval.functions import rules as R

WS_BODY = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WS = f"[{WS_BODY}]"
NW = "[^\\p{L}\\p{N}_]"

# RE2 spellings of the patterns whose \\b touches Arabic letters
RE2_OVERRIDES = {
    R.AMENITY_FLAGS[4][1]: ("\\b(ac|air\\s*condition|conditioning)\\b|"
                            f"(^|{NW})(تكييف|مكيف)($|{NW})"),
}


def re2(p: str) -> str:
    return RE2_OVERRIDES.get(p, p).replace("'", "''")


def m(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, '{re2(pattern)}')"


def flag(expr: str, pattern: str) -> str:
    return f"CAST({m(expr, pattern)} AS INTEGER)"


def cnt(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{re2(pattern)}')) AS INTEGER)"


def last_wins(expr: str, rules, default="NULL") -> str:
    whens = " ".join(f"WHEN {m(expr, p)} THEN {v}" for p, v in reversed(rules))
    return f"CASE {whens} ELSE {default} END"


def any_alias(expr: str, aliases) -> str:
    """True if a text holds one of the aliases; those of up to four characters only between separators."""
    tests = []
    for a in aliases:
        word = "lower('" + a.replace("'", "''") + "')"
        tests.append(f"contains({expr}, {word})" if len(a) > 4 else
                     f"regexp_matches({expr}, '(^|\\s)' || regexp_escape({word}) || '($|[\\s.,!])')")
    return "(" + " OR ".join(tests) + ")"


def kw_select(desc: str = "desc_clean") -> str:
    k = f"regexp_replace(lower(coalesce({desc}, '')), 'http\\S+|www\\.\\S+', ' ', 'g')"
    flags = [f"{flag(k, p)} AS nlp_{n}" for n, p in R.KWS]
    dl = f"least(greatest(length({k}) / 500.0, 0.0), 4.0)"
    score = " + ".join(flag(k, p) for _, p in R.KWS) + f" + {dl}"
    return ", ".join(flags + [f"{dl} AS desc_len", f"({score}) AS nlp_score"])


def semantic_select(desc: str = "desc_clean") -> str:
    k = f"regexp_replace(lower(coalesce({desc}, '')), 'http\\S+|www\\.\\S+', ' ', 'g')"
    return (f"CAST({cnt(k, R.LUXURY_TERMS)} AS DOUBLE) AS luxury_score, "
            f"CAST({cnt(k, R.BUDGET_TERMS)} AS DOUBLE) AS budget_score, "
            f"CAST({cnt(k, R.INVEST_TERMS)} AS DOUBLE) AS investment_signal")


def meta_select(raw: str) -> str:
    digits = f"CAST(len(regexp_extract_all({raw}, '\\p{{Nd}}')) AS INTEGER)"
    phone = R.PHONE_PATTERN.replace("\\s", WS_BODY)  # \\s only occurs inside classes here
    return ", ".join([
        f"CAST(regexp_matches({raw}, '{phone}') AS INTEGER) AS has_phone_in_desc",
        f"{cnt(raw, '[A-Z]')} / greatest(length({raw}), 1) AS caps_ratio",
        f"least({cnt(raw, '!')}, 10) AS excl_count",
        f"least(greatest({cnt(raw, '[.!?۔]')}, 1), 50) AS sentence_count",
        f"least({digits}, 100) AS num_count",
    ])


def content_select(desc: str = "desc_clean") -> str:
    raw = f"coalesce({desc}, '')"
    d = f"lower({raw})"
    yr_after = f"TRY_CAST(NULLIF(regexp_extract({d}, '{re2(R.DELIVERY_YEAR_AFTER)}', 1), '') AS DOUBLE)"
    yr_before = f"TRY_CAST(NULLIF(regexp_extract({d}, '{re2(R.DELIVERY_YEAR_BEFORE)}', 1), '') AS DOUBLE)"
    age_txt = f"TRY_CAST(NULLIF(regexp_extract({d}, '{re2(R.AGE_IN_YEARS)}', 1), '') AS DOUBLE)"
    age = f"coalesce(2026.0 - coalesce({yr_after}, {yr_before}), {age_txt})"
    g1 = f"NULLIF(regexp_extract({d}, '{re2(R.FLOOR_NUMBER)}', 1), '')"
    g2 = f"NULLIF(regexp_extract({d}, '{re2(R.FLOOR_NUMBER)}', 2), '')"
    level = f"coalesce({last_wins(d, R.FLOOR_RULES)}, TRY_CAST(coalesce({g1}, {g2}) AS DOUBLE))"
    cols = [
        f"CASE WHEN {age} >= 0 AND {age} <= 100 THEN {age} END AS building_age",
        f"{flag(d, R.UNDER_CONSTRUCTION)} AS under_construction",
        f"least(greatest({level}, 0.0), 50.0) AS floor_level",
        f"CAST({level} IS NOT NULL AS INTEGER) AS has_explicit_floor",
        f"CAST({last_wins(d, R.LEGAL_RULES, '0')} AS INTEGER) AS legal_status",
        f"CAST({last_wins(d, R.CONDITION_RULES)} AS DOUBLE) AS condition_score",
    ]
    for group in (R.AMENITY_FLAGS, R.MICRO_LOCATION_FLAGS, R.MOTIVATION_FLAGS):
        cols += [f"{flag(d, p)} AS {n}" for n, p in group]
    mot = dict(R.MOTIVATION_FLAGS)
    cols.append("(" + " + ".join(flag(d, mot[n]) for n in R.MOTIVATION_SCORE_PARTS) + ") AS motivation_score")
    for group in (R.EXPOSURE_FLAGS, R.ROOM_CONFIG_FLAGS):
        cols += [f"{flag(d, p)} AS {n}" for n, p in group]
    cols.append(meta_select(raw))
    return ", ".join(cols)


CONTENT_DOUBLES = ["building_age", "floor_level", "condition_score", "caps_ratio"]
