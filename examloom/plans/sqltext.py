"""Fragments of SQL that say what the Column functions say."""

from __future__ import annotations

import unicodedata

SPACE = r"[\p{Z}\s\x0b\x1c-\x1f\x85]"
# one-to-one compatibility forms of the blocks that the tables use, from Unicode's own data
_BLOCKS = (range(0xA0, 0x180), range(0x2000, 0x2150), range(0x2E80, 0x3100), range(0xF900, 0xFB00), range(0xFF00, 0xFFF0))
_ONE = [(chr(i), unicodedata.normalize("NFKC", chr(i))) for b in _BLOCKS for i in b]
_FROM = "".join(a for a, b in _ONE if a != b and len(b) == 1)
_TO = "".join(b for a, b in _ONE if a != b and len(b) == 1).replace("'", "''")


def nfkc(x: str) -> str:
    return f"nfc_normalize(translate(replace(replace({x}, '℃', '°C'), '…', '...'), '{_FROM}', '{_TO}'))"


def drop_spaces(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', '', 'g')"


def question_key(x: str) -> str:
    return drop_spaces(f"lower({nfkc(f"coalesce({x}, '')")})")


def stem(x: str) -> str:
    return f"regexp_replace(lower({nfkc(f"coalesce({x}, '')")}), '[\\p{{P}}\\p{{Z}}\\s\\x0b\\x1c-\\x1f\\x85]+', '', 'g')"


def display(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def fraction(*parts: str, sep: str = ":") -> str:
    joined = f" || '{sep}' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || sha256({joined})[1:12])::UBIGINT / 281474976710656.0::DOUBLE)"


def letters(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda c: c <> '')"


def strict(x: str, valid: str | None = None) -> str:
    c = f"upper(regexp_replace({x}, '[\\p{{Z}}\\s\\x0b\\x1c-\\x1f\\x85,，、/]', '', 'g'))"
    also = f" AND len(list_filter({letters(c)}, lambda k: NOT contains({valid}, k))) = 0" if valid else ""
    return f"CASE WHEN regexp_full_match({c}, '[A-Z]+') AND len(list_distinct({letters(c)})) = length({c}){also} THEN array_to_string(list_sort({letters(c)}), '') END"


def scorer(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(translate(upper(coalesce({x}, '')), 'ＡＢＣＤＥＦＧ', 'ABCDEFG'), '[A-G]'))), '')"


def wilson(k: str, n: str) -> tuple[str, str, str]:
    z = "1.959963984540054"
    centre, spread = f"({k}/{n} + {z}*{z}/(2*{n}))", f"{z}*sqrt({k}/{n}*(1-{k}/{n})/{n} + {z}*{z}/(4.0*{n}*{n}))"
    return f"({k}/{n})", f"greatest(0, ({centre} - {spread})/(1+{z}*{z}/{n}))", f"least(1, ({centre} + {spread})/(1+{z}*{z}/{n}))"


def mcnemar(b: str, c: str) -> str:
    n = f"({b}+{c})"
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform(range(0, least({b},{c})+1), lambda i: exp(lgamma({n}+1.0)-lgamma(i+1.0)-lgamma({n}-i+1.0)-{n}*ln(2.0))))) END"


# Parsed exam rows: columns row_id, split, question_type, q, t (all option texts), core (without empty ones at the end), ans, reason.
EXAM = f"""
exam0 AS (SELECT *, {display("question")} AS q, list_sort(map_keys(coalesce(options, MAP {{}}))) AS ls,
  upper(regexp_replace(coalesce(answer, ''), '[\\p{{Z}}\\s\\x0b\\x1c-\\x1f\\x85,，、/]', '', 'g')) AS ans FROM build_cmb_train_sft),
exam1 AS (SELECT *, list_transform(ls, lambda k: {display("options[k]")}) AS t FROM exam0),
exam2 AS (SELECT *, t[1:coalesce(list_max(list_transform(range(1, len(t)+1), lambda i: CASE WHEN t[i] <> '' THEN i ELSE 0 END)), 0)] AS core FROM exam1),
exam AS (SELECT *, CASE WHEN q = '' THEN 'empty_question' WHEN len(t) = 0 THEN 'empty_options'
  WHEN array_to_string(ls, '') <> 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[1:len(ls)] OR len(ls) < 3 THEN 'invalid_option_letters'
  WHEN list_contains(core, '') THEN 'empty_option_text' WHEN len(core) < 3 THEN 'too_few_options'
  WHEN len(list_distinct(core)) <> len(core) THEN 'duplicate_option_text'
  WHEN NOT regexp_full_match(ans, '[A-Z]+') OR len(list_distinct({letters("ans")})) <> length(ans) THEN 'invalid_answer'
  WHEN len(list_filter({letters("ans")}, lambda c: NOT list_contains(ls, c))) > 0 THEN 'answer_not_in_options'
  WHEN len(list_filter({letters("ans")}, lambda c: NOT list_contains(ls[1:len(core)], c))) > 0 THEN 'answer_on_empty_option' END AS reason FROM exam2)
"""
