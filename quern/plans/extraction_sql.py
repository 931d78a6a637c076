"""SQL of extraction: sections, phrases, experience, education and certificates of a text, and the score that needs them.

Its engine's patterns know neither look-ahead nor Unicode word boundaries, so what follows a match is part of the pattern,
and places come from the lengths of matches and of what lies between them.
"""

from __future__ import annotations

from quern.functions.sets import SYNONYMS
from quern.functions.text import NOISE, NOISE_PLACES, SKILL_LABELS, SKILL_TAILS
from quern.operators.extract import CERTIFICATES, EDUCATION, EDUCATION_LEVELS, LEVEL_RANKS, MOST_YEARS, PREFERRED_LINE, REQUIRED_LINE, RESUME_HEADS, SKILL_YEARS, YEARS_ONLY, YEARS_SKILL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_END = "[.,;:!?\"'']+$"
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"  # inside a class
_OUT = r"[^\p{L}\p{N}_]"


def wide(pattern: str) -> str:
    """The pattern with its white space and digits those of Unicode."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out, i = out + (_SPACE if inside else f"[{_SPACE}]"), i + 2
        elif two == r"\d":
            out, i = out + r"\p{Nd}", i + 2
        elif two[:1] == "\\":
            out, i = out + two, i + 2
        else:
            inside = True if two[0] == "[" else False if two[0] == "]" else inside
            out, i = out + two[0], i + 1
    return out


def norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({strip(c)}), '{_END}', ''), '\\s+', ' ', 'g')"


NAMES = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in SYNONYMS.items()) + "}"


def canon(c: str, names: str = NAMES) -> str:
    return f"coalesce({names}[{c}], {c})"


def expanded(c: str) -> str:
    """Skill list c as its distinct forms, in order."""
    forms = f"""flatten(list_transform(list_transform(list_transform(list_filter(coalesce({c}, []::VARCHAR[]), lambda s: s IS NOT NULL),
        lambda s: {norm('s')}), lambda n: [n, {canon('n')}]), lambda p: [p[1], p[2], {strip("regexp_replace(p[2], '[-/]', ' ', 'g')")}]))"""
    return f"list_transform([{forms}], lambda fs: list_filter(fs, lambda s, i: list_position(fs, s) = i))[1]"


def cleaned(c: str) -> str:
    """T14."""
    out = f"regexp_replace(lower({strip(c)}), '{_END}', '')"
    for t in SKILL_TAILS:
        out = f"list_transform([{out}], lambda o: CASE WHEN suffix(o, {q(t)}) THEN {strip(f'left(o, length(o) - {len(t)})')} ELSE o END)[1]"
    return f"list_transform([regexp_replace({out}, '{_END}', '')], lambda o: CASE WHEN o IN ({', '.join(map(q, SKILL_LABELS))}) THEN '' ELSE o END)[1]"


def noisy(v: str) -> str:
    t = f"lower({strip(v)})"
    return f"(length({t}) <= 1 OR {t} IN ({', '.join(map(q, NOISE_PLACES))}) OR regexp_matches({t}, {q('|'.join(f'(?:{p})' for p in NOISE))}))"


def sections(src: str, key: str, text: str) -> str:
    """CTE sec(key, required, preferred) of R01."""
    return f"""sl AS (SELECT {key}, string_split_regex({text}, '\\r\\n|[\\n\\r\\v\\f\\x{{85}}]') AS ls FROM {src}), su AS (SELECT {key}, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM sl),
        sh AS (SELECT *, CASE WHEN regexp_matches(trim(line), {q(PREFERRED_LINE)}, 'i') THEN 2 WHEN regexp_matches(trim(line), {q(REQUIRED_LINE)}, 'i') THEN 1 END AS head FROM su),
        ss AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY k), 1) AS state FROM sh),
        sg AS (SELECT {key}, bool_or(coalesce(head = 1, false)) AS has, string_agg(line, chr(10) ORDER BY k) FILTER (head IS NULL AND state = 1) AS r, string_agg(line, chr(10) ORDER BY k) FILTER (head IS NULL AND state = 2) AS p FROM ss GROUP BY {key}),
        sec AS (SELECT d.{key}, CASE WHEN has THEN {strip("coalesce(r, '')")} ELSE {strip('d.' + text)} END AS required, CASE WHEN d.{text} IS NOT NULL THEN {strip("coalesce(p, '')")} END AS preferred FROM {src} d LEFT JOIN sg USING ({key}))"""


SKILL_NAMES = "SELECT DISTINCT lower(unnest(list_concat([canon_value], coalesce(alt_names, []::VARCHAR[])))) AS phrase, 'skill' AS category FROM canon_values WHERE kind = 'skill'"
_NEGATION = rf"(?:^|{_OUT})(no|not|without|don'?t need|doesn'?t require)(?:[^.!?\n\p{{L}}\p{{N}}_][^.!?\n]{{0,39}})?\n?$"
_NOT_ASKED = rf"(?i)(?:^|{_OUT})(no|not|without|don'?t need|doesn'?t require|waive|waiving)(?:[^.!?\n\p{{L}}\p{{N}}_][^.!?\n]{{0,49}})?\n?$"


def _word(c: str) -> str:
    return f"regexp_matches({c}, '^[\\p{{L}}\\p{{N}}_]')"


def phrases(src: str, key: str, text: str, dictionary: str, out: str = "hit") -> str:
    """CTE hit(key, phrase, category, ofs from 0) of R06. Rows of src that share a key are different texts of different parts."""
    p = out[0]
    return f"""{p}d AS ({dictionary}), {p}t AS (SELECT {key}, lower({text}) AS low FROM {src} WHERE {text} IS NOT NULL),
        {p}s AS (SELECT {key}, low, phrase, string_split(low, phrase) AS ps FROM {p}t, (SELECT DISTINCT phrase FROM {p}d) WHERE contains(low, phrase)),
        {p}o AS (SELECT {key}, low, phrase, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(phrase))::INT AS ofs FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM {p}s)),
        {p}g AS (SELECT * FROM {p}o WHERE {_word("substr(low, ofs, 1)")} <> {_word("left(phrase, 1)")} AND {_word("right(phrase, 1)")} <> {_word("substr(low, ofs + length(phrase) + 1, 1)")}
          AND NOT regexp_matches(substr(low, greatest(0, ofs - 50) + 1, least(ofs, 50)), {q(_NEGATION)})),
        {p}k AS (SELECT {key}, phrase, ofs FROM {p}g g WHERE NOT EXISTS (SELECT 1 FROM {p}g h WHERE h.{key} = g.{key} AND length(h.phrase) > length(g.phrase) AND h.ofs <= g.ofs AND g.ofs + length(g.phrase) <= h.ofs + length(h.phrase))),
        {out} AS (SELECT {key}, k.phrase, min(category) AS category, ofs FROM {p}k k JOIN {p}d USING (phrase) GROUP BY ALL)"""


def _matches(src: str, key: str, text: str, forms: list[tuple], out: str) -> str:
    """CTE out(key, rank, text, ofs from 0, n, m): matches of patterns whose first group is what counts, m its inner groups as a list.

    forms: pattern, number of inner groups and, for dear ones, a pattern that spares texts the first."""
    bare = lambda p: p.replace("(?:", "(").replace("(", "(?:").replace("(?:?i)", "(?i)")
    one = " UNION ALL ".join(
        f"SELECT {key}, {r} AS rank, {text} AS text, string_split_regex({text}, {q(bare(p))}) AS gaps, regexp_extract_all({text}, {q(bare(p))}) AS whole "
        f"FROM {src} WHERE regexp_matches({text}, {q(w[0] if w else bare(p))})"
        for r, (p, _, *w) in enumerate(forms)
    )
    inner = lambda g: "CASE rank " + " ".join(f"WHEN {r} THEN regexp_extract(w, {q(p)}, {g})" for r, (p, n, *_) in enumerate(forms) if g <= n + 1) + " END"
    groups = ", ".join(inner(g) for g in range(2, 2 + max(f[1] for f in forms))) if any(f[1] for f in forms) else ""
    return f"""{out}0 AS ({one}),
        {out}1 AS (SELECT {key}, rank, text, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::INT AS ofs, whole[i] || CASE WHEN ofs + length(whole[i]) < length(text) THEN '~' ELSE '' END AS w
          FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM {out}0)),
        {out} AS (SELECT {key}, rank, text, ofs, {inner(1)} AS raw, length(raw) AS n, [{groups}]::VARCHAR[] AS m FROM {out}1)"""


_AHEAD = r"(?=\s+(?:and|or|with|experience|,|$|\.)|\s*$)"
_CONSUMED = r"(?:\s+(?:and|or|with|experience|,|\.)|\s*$)"


def experience(src: str, key: str, text: str) -> str:
    """CTE exp(key, place, skill, years, is_minimum) of R02."""
    first = YEARS_SKILL.replace(_AHEAD, "")
    forms = [("(?i)(" + wide(first) + ")" + wide(_CONSUMED), 2), ("(?i)(" + wide(YEARS_ONLY) + ")", 1), ("(?i)(" + wide(SKILL_YEARS) + ")", 2, wide(r"(?i):\s*\d+\s*\+?\s*year"))]
    return f"""{_matches(src, key, text, forms, 'em')},
        eg AS (SELECT * FROM em WHERE NOT regexp_matches(substr(text, greatest(0, ofs - 60) + 1, least(ofs, 60)), {q(_NOT_ASKED)})),
        ek AS (SELECT * FROM eg g WHERE NOT EXISTS (SELECT 1 FROM eg h WHERE h.{key} = g.{key} AND h.rank < g.rank AND h.ofs <= g.ofs AND g.ofs + g.n <= h.ofs + h.n)),
        ex AS (SELECT {key}, rank, ofs, CASE rank WHEN 0 THEN {cleaned('m[2]')} WHEN 1 THEN '' ELSE {cleaned('m[1]')} END AS skill, (CASE rank WHEN 2 THEN m[2] ELSE m[1] END)::HUGEINT AS years, contains(raw, '+') AS is_minimum FROM ek),
        exp AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY rank, ofs) AS place, skill, years::INT AS years, is_minimum FROM ex WHERE years <= {MOST_YEARS} AND NOT (rank = 0 AND skill = ''))"""


_WISHED = rf"(?i)(?:^|{_OUT})(preferred|desired|nice[{_SPACE}]+to[{_SPACE}]+have|plus|advantage)(?:{_OUT}|$)"


def education(src: str, key: str, text: str) -> str:
    """CTE edu(key, place, level, field, is_required) of R03."""
    form = f"{strip('rtrim(lower(m[1]), ' + q(chr(39) + 's') + ')')}"
    level = "CASE " + " ".join(f"WHEN starts_with(form, {q(k)}) THEN {q(v)}" for k, v in EDUCATION_LEVELS.items()) + " END"
    return f"""{_matches(src, key, text, [('(?i)(' + wide(EDUCATION) + ')', 2)], 'dm')},
        df AS (SELECT *, {form} AS form FROM dm), dl AS (SELECT *, {level} AS level FROM df),
        d1 AS (SELECT * FROM dl WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key}, level ORDER BY ofs) = 1),
        edu AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY ofs) AS place, level, {cleaned("coalesce(m[2], '')")} AS field, NOT regexp_matches(substr(text, ofs + n + 1, 80), {q(_WISHED)}) AS is_required FROM d1)"""


def certificates(src: str, key: str, text: str) -> str:
    """CTE cert(key, name, is_required) of R04."""
    return f"""{_matches(src, key, text, [('(?i)(' + wide(p) + ')', 0) for p in CERTIFICATES], 'cm')},
        cn AS (SELECT *, regexp_replace(trim(regexp_replace(lower(raw), '[{_SPACE}]+', ' ', 'g')), ' +', ' ', 'g') AS name FROM cm),
        cert AS (SELECT {key}, name, NOT regexp_matches(substr(text, greatest(0, ofs - 40) + 1, ofs + n + 80 - greatest(0, ofs - 40)), {q(_WISHED)}) AS is_required
          FROM cn QUALIFY row_number() OVER (PARTITION BY {key}, name ORDER BY rank, ofs) = 1)"""


RANK = "CASE level " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in LEVEL_RANKS.items()) + " END"


def facts(src: str, key: str = "id", text: str = "job_description") -> str:
    """CTE facts(key, req, pref, asked, level) of C11: skills by section in sorted order, skills that years are asked of, the highest level."""
    skills = lambda part, h: f"{h}l AS (SELECT {key}, list(DISTINCT phrase ORDER BY phrase) AS l FROM {h} WHERE NOT {noisy('phrase')} GROUP BY {key})"  # noqa: E731, ARG005
    return f"""{sections(src, key, text)}, fr AS (SELECT {key}, coalesce(nullif(s.required, ''), {text}) AS part FROM sec s JOIN {src} USING ({key})), fp AS (SELECT {key}, preferred AS part FROM sec),
        {phrases('fr', key, 'part', SKILL_NAMES, 'xhit')}, {phrases('fp', key, 'part', SKILL_NAMES, 'yhit')}, {skills('r', 'xhit')}, {skills('p', 'yhit')},
        {experience(src, key, text)}, {education(src, key, text)},
        el AS (SELECT {key}, list(skill ORDER BY place) AS asked FROM exp GROUP BY {key}), dr AS (SELECT {key}, arg_max(level, {RANK} - place / 1000.0) AS level FROM edu GROUP BY {key}),
        facts AS (SELECT s.{key}, coalesce(x.l, []::VARCHAR[]) AS req, list_filter(coalesce(y.l, []::VARCHAR[]), lambda v: NOT list_contains(coalesce(x.l, []::VARCHAR[]), v)) AS pref,
          coalesce(asked, []::VARCHAR[]) AS asked, level FROM {src} s LEFT JOIN xhitl x USING ({key}) LEFT JOIN yhitl y USING ({key}) LEFT JOIN el USING ({key}) LEFT JOIN dr USING ({key}))"""


def score(src: str) -> str:
    """CTE scored: src (req, pref, resume_skills, asked, level) with the parts of C02 and total."""
    low = "list_transform(coalesce(resume_skills, []::VARCHAR[]), lambda s: lower(s))"
    have = f"""CASE WHEN list_has_any({low}, ['phd', 'ph.d', 'doctorate']) THEN 4 WHEN list_has_any({low}, ['master', 'masters', 'm.s.', 'ms', 'mba']) THEN 3
        WHEN list_has_any({low}, ['bachelor', 'bachelors', 'b.s.', 'bs', 'undergraduate']) THEN 2 WHEN list_has_any({low}, ['associate']) THEN 1 ELSE 0 END"""
    names = f"list_transform(list_filter(coalesce(resume_skills, []::VARCHAR[]), lambda s: s IS NOT NULL), lambda s: {canon(norm('s'))})"
    part = lambda n, f: f"CASE WHEN {n} AND len({f}) > 0 THEN len(list_intersect({f}, rf)) / len({f}) * 100.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""sc1 AS (SELECT *, {expanded('req')} AS qf, {expanded('pref')} AS pf, {expanded('resume_skills')} AS rf, len(coalesce(req, []::VARCHAR[])) > 0 AS some_q, len(coalesce(pref, []::VARCHAR[])) > 0 AS some_p,
          {names} AS names, {have} AS have, {RANK} AS want FROM {src}),
        sc2 AS (SELECT *, {part('some_q', 'qf')} AS q, {part('some_p', 'pf')} AS p,
          CASE WHEN len(asked) > 0 THEN list_sum(list_transform(asked, lambda s: CASE WHEN s = '' THEN 75.0::DOUBLE WHEN list_contains(names, {canon(norm('s'))}) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)) / len(asked) ELSE 100.0::DOUBLE END AS e,
          CASE WHEN want IS NULL OR have >= want THEN 100.0::DOUBLE WHEN have = want - 1 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS d,
          least(CASE WHEN some_q THEN len(list_filter(rf, lambda z: NOT list_contains(qf, z))) ELSE 0 END * 0.5::DOUBLE, 5.0::DOUBLE) AS bonus FROM sc1),
        scored AS (SELECT *, round(least(q * CASE WHEN some_p THEN 0.40::DOUBLE ELSE 0.40::DOUBLE + 0.30::DOUBLE END + p * CASE WHEN some_p THEN 0.30::DOUBLE ELSE 0.0::DOUBLE END + e * 0.20::DOUBLE + d * 0.10::DOUBLE + bonus, 100.0::DOUBLE), 2) AS total FROM sc2)"""
