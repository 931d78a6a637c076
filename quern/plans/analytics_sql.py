"""SQL that gives the rows of the queries in analytics."""

from __future__ import annotations

from quern.functions.sets import SYNONYMS
from quern.functions.text import NO_SALARY, PLAIN_WORDS
from quern.operators.classify import DOMAIN_KEYWORDS, OTHER_SIGNS, RESUME_SIGNS
from quern.operators.resumes import BULLET_WORDS, BULLETS, CATEGORIES, COMMON_WORDS, FIGURES, FILLERS, OTHER_CATEGORY, SECTIONS, SUMMARY_WORDS, TOKENS, UNFIT
from quern.plans import extraction_sql as x
from quern.plans.extraction_sql import SKILL_NAMES, canon, cleaned, expanded, facts, noisy, norm, phrases, q, score, sections, strip

_MORE = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in (SYNONYMS | {"apache spark": "spark", "unit testing": "testing"}).items()) + "}"


#: Readable resumes as JSON objects.
_JSON = """c AS (SELECT id, CASE WHEN json_valid({col}) THEN CASE WHEN json_type({col}) = 'VARCHAR' THEN {col}::JSON->>'$' ELSE {col} END END AS j FROM {tab}),
    r AS (SELECT id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'OBJECT' THEN j::JSON END END AS j FROM c)"""
MASTERS = _JSON.format(col="content", tab="master_resumes")


def strings(j: str) -> str:
    """JSON j as a list of its texts, a single text as one; nulls and blanks left out."""
    return f"""list_filter(CASE json_type({j}) WHEN 'ARRAY' THEN list_transform(({j})::JSON[], lambda v: v->>'$') WHEN 'VARCHAR' THEN [({j})->>'$'] ELSE [] END,
        lambda s: s IS NOT NULL AND length(trim(s)) > 0)"""


def objects(j: str) -> str:
    return f"list_filter(CASE json_type({j}) WHEN 'ARRAY' THEN ({j})::JSON[] WHEN 'OBJECT' THEN [{j}] ELSE [] END, lambda x: json_type(x) = 'OBJECT')"


def newer(a: str, b: str) -> str:
    """The value under a, or under b if a is absent or null."""
    return f"CASE WHEN coalesce(json_type(j->'$.{a}'), 'NULL') = 'NULL' THEN j->'$.{b}' ELSE j->'$.{a}' END"


PARTS = f"""{MASTERS}, s AS (SELECT id, {newer('work_experience', 'experience')} AS w, j->'$.skills' AS k, j->'$.projects' AS p, j->'$.certifications' AS e,
        coalesce(nullif(j->>'$.professional_summary', NULL), j->>'$.summary') AS summary, j FROM r),
    parts AS (SELECT id, summary, j, {objects('w')} AS positions, {objects('p')} AS projects,
        CASE json_type(k) WHEN 'OBJECT' THEN list_filter(flatten(map_values(k::MAP(VARCHAR, VARCHAR[]))), lambda s: s IS NOT NULL AND s <> '') ELSE {strings('k')} END AS skills,
        list_filter(list_transform(CASE json_type(e) WHEN 'ARRAY' THEN e::JSON[] WHEN 'OBJECT' THEN [e] WHEN 'VARCHAR' THEN [e] ELSE [] END,
          lambda x: CASE json_type(x) WHEN 'OBJECT' THEN coalesce(x->>'$.name', x->>'$.title') ELSE x->>'$' END), lambda s: s IS NOT NULL AND trim(s) <> '') AS certs FROM s),
    bul AS (SELECT *, flatten(list_transform(list_concat(positions, projects), lambda x: {strings("x->'$.bullets'")})) AS bullets FROM parts)"""
SKILLS = f"{PARTS}, rs AS (SELECT id AS resume_id, list_concat(skills, certs) AS resume_skills FROM parts)"
PAIRS = f"""{SKILLS}, pairs AS (SELECT t.id AS tailored_id, jb.*, rs.resume_skills FROM tailored_resumes t JOIN jobs jb ON jb.id = t.job_id JOIN rs ON rs.resume_id = t.master_resume_id)"""


def match(src: str) -> str:
    return f"m AS (SELECT *, {expanded('required_skills')} AS a, {expanded('resume_skills')} AS b, len(coalesce(required_skills, []::VARCHAR[])) > 0 AS asked FROM {src})"


SCORE = "round(CASE WHEN asked THEN len(list_intersect(a, b)) / len(a) * 100.0 ELSE 0 END, 6)"
_MINUS = "list_filter({a}, lambda z: NOT list_contains({b}, z))"

_LIST = "coalesce(array_to_string({a}, '|'), '')"
#: Skills of an advert, or those of its text where it lists none.
_LISTED = "coalesce(required_skills, req) AS req, CASE WHEN required_skills IS NULL THEN coalesce(preferred_skills, pref) ELSE coalesce(preferred_skills, []::VARCHAR[]) END AS pref"
_KEYWORDS = """SELECT DISTINCT lower(unnest(list_concat([canon_value], coalesce(alt_names, []::VARCHAR[])))) AS phrase, kind AS category FROM canon_values WHERE kind IS NOT NULL
    UNION ALL SELECT unnest(['mentor', 'coach', 'organise', 'negotiate', 'trust', 'clarity', 'strong interest', 'willingness']), 'soft_skills'"""
_HALVES = f"""j AS (SELECT *, coalesce(date_scraped < TIMESTAMPTZ '2025-07-01 00:00:00+00', false) AS early FROM jobs),
    o AS (SELECT * FROM j WHERE early QUALIFY row_number() OVER (PARTITION BY application_url ORDER BY id DESC) = 1),
    v AS (SELECT * FROM j WHERE id % 17 <> 0 AND {' AND '.join(f"coalesce(length({strip(c)}), 0) > 0" for c in ('job_title', 'company_name', 'job_description', 'application_url'))})"""
_DEMANDS = ("AWS Certified Developer Associate preferred", "PMP or Certified Scrum Master is a plus", "Six  Sigma Green Belt and CISSP required", "CompTIA Security+ desired; ITIL v4", "Bachelor's degree in Physics or an MBA, PhD preferred")
_DEMANDING = f"""dj AS (SELECT id, concat(job_description, ' ', id % 30, '+ years of ', required_skills[1], ' and more. No 4 years of ', required_skills[2], ' needed. ', required_skills[3], ': ', id % 9, ' years. ',
    [{', '.join(map(q, _DEMANDS))}][id % 5 + 1]) AS text FROM jobs)"""
#: Characters beyond Latin-1 that a western console shows.
_WESTERN = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252")


def _n_skills(k: str = "k") -> str:
    return f"CASE json_type({k}) WHEN 'OBJECT' THEN len(json_keys({k})) ELSE len({strings(k)}) END"


def ordered(j: str, names: tuple[str, ...]) -> str:
    """names in the order that section_order of j gives, the rest after them."""
    ord_ = f"list_transform(coalesce({strings(j + "->'$.section_order'")}, []::VARCHAR[]), lambda s: replace(lower(trim(s)), ' ', '_'))"
    all_ = "[" + ", ".join(map(q, names)) + "]"
    head = f"list_filter({ord_}, lambda s, i: list_contains({all_}, s) AND list_position({ord_}, s) = i)"
    return f"array_to_string(list_concat({head}, list_filter({all_}, lambda s: NOT list_contains({head}, s))), '|')"


def gap_hit(s: str, have: str) -> str:
    low = f"lower({strip(s)})"
    name = canon(norm(s))
    same = f"len(list_filter({have}, lambda r: {canon(norm('r'))} = {name})) > 0"
    near = f"length({low}) >= 4 AND len(list_filter({have}, lambda r: contains(r, {low}) OR contains({low}, r))) > 0"
    return f"(list_contains({have}, {low}) OR list_contains({have}, {name}) OR {same} OR ({near}))"


_WORD = r"[^\p{L}\p{N}_]"


def count_words(text: str, word: str) -> str:
    """Times word stands in text between characters that belong to no word (text with those doubled)."""
    return f"len(regexp_extract_all({text}, {q(_WORD + word.replace(' ', '  ') + _WORD)}))"


def doubled(c: str) -> str:
    return f"'  ' || regexp_replace(lower(coalesce({c}, '')), '({_WORD})', '\\1\\1', 'g') || '  '"


def domain(src: str, title: str, body: str, key: str) -> str:
    names = ", ".join(f"{{'d': {q(d)}, 's': " + " + ".join(f"3 * {count_words('t', w)} + {count_words('b', w)}" for w in ws) + "}" for d, ws in DOMAIN_KEYWORDS.items())
    return f"""x AS (SELECT {key}, {doubled(title)} AS t, {doubled(body)} AS b FROM {src}), y AS (SELECT {key}, [{names}] AS v FROM x),
        z AS (SELECT {key}, v, list_max(list_transform(v, lambda e: e.s)) AS best, list_sum(list_transform(v, lambda e: e.s)) AS total FROM y),
        dom AS (SELECT {key}, best, total, best > 0 AND len(list_filter(v, lambda e: e.s = best)) = 1 AS clear, list_filter(v, lambda e: e.s = best)[1].d AS d FROM z)"""


def _signs(signs: tuple[str, ...]) -> str:
    return " + ".join(f"contains(low, {q(s)})::INT" for s in signs)


_SKILL_ROWS = "(SELECT DISTINCT s FROM (SELECT unnest(required_skills) AS s FROM jobs) WHERE s IS NOT NULL)"
_WORDS_OF = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def voice(c: str) -> str:
    t = f"' ' || regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', ' \\0 ', 'g'), '  +', ' ', 'g') || ' '"
    # words between blanks: "i've" has become "i ' ve", whose "i" counts once, as it does in the pattern
    first = f"len(list_filter(regexp_split_to_array({t}, ' '), lambda w: w IN ('i', 'my', 'me')))"
    third = f"len(list_filter(regexp_split_to_array({t}, ' '), lambda w: w IN ('he', 'she', 'they', 'his', 'her', 'their', 'him', 'them')))"
    return f"CASE WHEN {first} > 2 THEN 'first_person' WHEN {third} > 2 THEN 'third_person' ELSE 'no_pronouns' END"


_OPENS = {ch: f"coalesce(starts_with({strip('x')}, {q(ch)}), false)" for ch in BULLETS}
_BARE = "CASE " + " ".join(f"WHEN {o} THEN {strip(f'substr({strip(chr(120))}, 2)')}" for o in _OPENS.values()) + f" ELSE {strip('x')} END"
#: Tailored resumes beside their masters and the advert's words.
_BOTH = f"""{PARTS}, t0 AS (SELECT id, CASE WHEN json_valid(tailored_content) THEN CASE WHEN json_type(tailored_content) = 'VARCHAR' THEN tailored_content::JSON->>'$' ELSE tailored_content END END AS j FROM tailored_resumes),
    t1 AS (SELECT id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'OBJECT' THEN j::JSON END END AS j FROM t0),
    t2 AS (SELECT id, {newer('work_experience', 'experience')} AS w, j->'$.skills' AS k, coalesce(nullif(j->>'$.professional_summary', NULL), j->>'$.summary') AS new_summary FROM t1),
    t3 AS (SELECT id, {objects('w')} AS news, new_summary, {_n_skills()} AS n_new_skills FROM t2),
    aw AS (SELECT id AS job_id, list_filter(list_concat(coalesce(required_skills, []::VARCHAR[]), coalesce(preferred_skills, []::VARCHAR[])), lambda s: s IS NOT NULL) AS l FROM jobs),
    words AS (SELECT job_id, list_filter(l, lambda s, i: list_position(l, s) = i) AS words FROM aw),
    mp AS (SELECT m.id AS mid, coalesce(b.positions, []::JSON[]) AS olds, coalesce(b.projects, []::JSON[]) AS projects, coalesce(b.skills, []::VARCHAR[]) AS skills, coalesce(b.bullets, []::VARCHAR[]) AS bullets, b.summary, b.j, b.k, coalesce(b.n_skills, 0) AS n_skills
      FROM master_resumes m LEFT JOIN (SELECT *, j->'$.skills' AS k, {_n_skills("j->'$.skills'")} AS n_skills FROM bul) b ON b.id = m.id),
    both_sides AS (SELECT tr.id, words, coalesce(news, []::JSON[]) AS news, new_summary, coalesce(n_new_skills, 0) AS n_new_skills, mp.* FROM tailored_resumes tr LEFT JOIN t3 USING (id) LEFT JOIN words USING (job_id) JOIN mp ON mid = tr.master_resume_id)"""
_CHANGED = f"""{_BOTH}, pos AS (SELECT id, words, olds, news, unnest(range(least(len(olds), len(news)))) AS position FROM both_sides),
    pb AS (SELECT id, words, position, {strings("olds[position + 1]->'$.bullets'")} AS o, {strings("news[position + 1]->'$.bullets'")} AS n FROM pos),
    place AS (SELECT id, words, position::INT AS position, o, n, unnest(range(least(len(o), len(n)))) AS k FROM pb),
    changed AS (SELECT id, words, position, k::INT AS place, o[k + 1] AS original, n[k + 1] AS modified FROM place)"""


def lost(o: str, m: str) -> str:
    return f"len(list_filter(regexp_extract_all({o}, {q(FIGURES)}, 1), lambda f: NOT list_contains(regexp_extract_all({m}, {q(FIGURES)}, 1), f))) > 0"


def warnings(least: int, most: int, bullet: bool) -> str:
    """Warnings of modified for original, of a bullet or a summary."""
    n = f"len(list_filter(regexp_split_to_array({strip('modified')}, '\\s+'), lambda w: w <> ''))"
    has = lambda ws: "(" + " OR ".join(f"contains(lower(modified), {q(w)})" for w in ws) + ")"
    old = f"list_transform(regexp_extract_all(original, {q(TOKENS)}, 1), lambda s: lower(s))"
    known = "list_transform(coalesce(words, []::VARCHAR[]), lambda s: lower(s))"
    fresh = f"len(list_filter(regexp_extract_all(modified, {q(TOKENS)}, 1), lambda t: NOT list_contains({old}, lower(t)) AND NOT list_contains({known}, lower(t)) AND lower(t) NOT IN ({', '.join(map(q, COMMON_WORDS))}) AND (regexp_matches(t, '[0-9]') OR (regexp_matches(t, '^[A-Z]') AND length(t) > 4)))) > 0"
    named = [("figures removed", lost("original", "modified") if bullet else "false"), ("too short", f"{n} < {least}"), ("too long", f"{n} > {most}"), ("unfit word", has(UNFIT)), ("filler phrase", has(FILLERS) if bullet else "false"), ("new skill", fresh), ("empty", f"{n} = 0")]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(k)} END" for k, c in named) + "], lambda w: w IS NOT NULL)"


def kw_hits(text: str, words: str = "words") -> str:
    return f"len(list_filter(list_distinct(list_transform(coalesce({words}, []::VARCHAR[]), lambda w: lower(w))), lambda w: contains(lower({text}), w)))"


def cover(text: str) -> str:
    return f"CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda w: contains(lower({text}), lower(w)))) / len(words) * 100, 1) ELSE 0.0 END"


_TAILORING = f"""{_BOTH}, mb AS (SELECT id, olds, news, unnest(range(len(olds))) AS p FROM both_sides),
    mo AS (SELECT id, p, {strings("olds[p + 1]->'$.bullets'")} AS o, CASE WHEN p < len(news) THEN {strings("news[p + 1]->'$.bullets'")} ELSE []::VARCHAR[] END AS n FROM mb),
    mk AS (SELECT id, p, o, n, unnest(range(len(o))) AS k FROM mo),
    ml AS (SELECT id, p, k, o[k + 1] AS o, n[k + 1] AS m FROM mk),
    mm AS (SELECT id, string_agg(o, ' ' ORDER BY p, k) AS old_text, string_agg(CASE WHEN m IS NULL OR {lost('o', 'm')} THEN o ELSE m END, ' ' ORDER BY p, k) AS new_text, count(*) FILTER (o <> m AND {lost('o', 'm')}) AS n_rejected FROM ml GROUP BY id),
    x0 AS (SELECT b.*, concat_ws(' ', summary, coalesce(old_text, '')) AS before, concat_ws(' ', coalesce(nullif(new_summary, ''), summary), coalesce(new_text, '')) AS after, coalesce(n_rejected, 0) AS n_rejected,
      CASE WHEN json_type(k) = 'OBJECT' THEN json_keys(k) END AS names FROM both_sides b LEFT JOIN mm USING (id)),
    x1 AS (SELECT *, list_transform(skills, lambda s: lower(s)) AS have, list_transform(words, lambda s: lower(s)) AS lw FROM x0),
    x2 AS (SELECT *, list_filter(words, lambda w, i: contains(lower(after), lower(w)) AND NOT list_contains(have, lower(w)) AND list_position(lw, lower(w)) = i) AS fresh FROM x1),
    x3 AS (SELECT *, CASE WHEN names IS NOT NULL THEN coalesce(list_filter([{', '.join(map(q, CATEGORIES))}], lambda c: list_contains(names, c))[1], {q(OTHER_CATEGORY)}) END AS target FROM x2),
    x4 AS (SELECT *, CASE WHEN names IS NULL THEN NULL WHEN len(fresh) = 0 OR list_contains(names, target) THEN names ELSE list_append(names, target) END AS new_names FROM x3),
    x5 AS (SELECT *, CASE WHEN names IS NULL THEN [list_concat(skills, fresh)] ELSE list_transform(new_names, lambda c: list_concat(CASE WHEN list_contains(names, c) THEN coalesce((k::MAP(VARCHAR, VARCHAR[]))[c], []::VARCHAR[]) ELSE []::VARCHAR[] END, CASE WHEN c = target THEN fresh ELSE []::VARCHAR[] END)) END AS gs FROM x4),
    x6 AS (SELECT *, flatten(list_transform(gs, lambda g: list_concat(list_filter(g, lambda s: coalesce(list_contains(lw, lower(s)), false)), list_filter(g, lambda s: NOT coalesce(list_contains(lw, lower(s)), false))))) AS listed FROM x5),
    x7 AS (SELECT *, {cover("concat_ws(' ', before, array_to_string(coalesce(names, skills), ' '))")} AS coverage_before, {cover("concat_ws(' ', after, array_to_string(coalesce(new_names, listed), ' '))")} AS coverage_after FROM x6)"""
_LOG = """log AS (SELECT event_id || ' ' || CASE event_type WHEN 'error' THEN 'ERROR 429 quota' WHEN 'view' THEN 'WARNING slow' WHEN 'purchase' THEN '[scheduler] Job ''scrape_jobs'' OK'
    WHEN 'click' THEN '[scrape_jobs] Starting' ELSE (event_id % 7) || ' saved, ' || (event_id % 3) || ' updated,' END AS line FROM events)"""
_YEARS = r"regexp_extract_all(coalesce(nullif(x->>'$.dates', ''), x->>'$.duration', ''), '\d{4}')"
_MERGE_NEW = "list_filter(coalesce(preferred_skills, []::VARCHAR[]), lambda s: s IS NOT NULL AND s <> '')"
_LOWERED = "list_transform({a}, lambda y: lower(y))"

SQL = {
    "t01_normalised_titles": f"SELECT id, {norm(chr(39) + ' ' + chr(39) + ' || company_name || ' + chr(39) + ' ;!' + chr(39))} AS name FROM jobs",
    "t02_canonical_skills": f"SELECT {canon('n', _MORE)} AS skill, count(*) AS n FROM (SELECT {norm('s')} AS n FROM (SELECT unnest(required_skills) AS s FROM jobs) WHERE s IS NOT NULL) GROUP BY 1",
    "t03_expanded": f"SELECT id, array_to_string({expanded('required_skills')}, '|') AS forms FROM jobs",
    "t04_clean": "SELECT id, trim(regexp_replace(coalesce(job_description, ''), '\\s+', ' ', 'g')) AS clean FROM jobs",
    "t05_truncated": "SELECT id, CASE WHEN length(job_description) <= 100 THEN job_description ELSE regexp_replace(left(job_description, 100), ' [^ ]*\\z', '') || '…' END AS short FROM jobs",
    "t06_html": f"SELECT id, {strip(chr(39) + 'A & B ' + chr(39) + ' || regexp_replace(company_name, ' + chr(39) + '[\\s]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM jobs",
    "t07_urls": "SELECT id, split_part(application_url, '?', 1) AS bare, 'https://board.example/viewjob?jk=k' || id AS canonical FROM jobs",
    "t08_slug_and_host": "SELECT id, left(replace(replace(replace(application_url, 'https://', ''), 'http://', ''), '/', '_'), 50) AS slug, nullif(regexp_extract(application_url, '^[a-z]+://(?:www\\.)?([^/?#]+)', 1), '') AS host FROM jobs",
    "t09_sentences": f"""SELECT id, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(job_description, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> ''), '|'), '') AS sentences FROM jobs""",
    "t10_first_sentence": f"""SELECT id, coalesce(left(list_filter(list_transform(string_split(regexp_replace(job_description, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}),
        lambda s: s <> '' AND contains(lower(s), 'travel'))[1], 200), '') AS sentence FROM jobs""",
    "t11_noise": f"SELECT v, {noisy('v')} AS noise FROM (SELECT DISTINCT lower(location) AS v FROM jobs WHERE location IS NOT NULL)",
    "t12_technical": f"""SELECT s, length(s) >= 2 AND (regexp_matches(s, '[0-9]') OR regexp_matches(s, '[.+-]') OR NOT (lower(s) IN ({', '.join(map(q, PLAIN_WORDS))}))) AS technical FROM {_SKILL_ROWS}""",
    "t13_negated": r"""SELECT id, coalesce(k > 0 AND regexp_matches(substr(low, greatest(1, k - 50), k - greatest(1, k - 50)), '(?:^|[^\p{L}\p{M}\p{N}_])(no|not|without|don''?t need|doesn''?t require)(?:[^.!?\n\p{L}\p{M}\p{N}_][^.!?\n]{0,39})?\n?$'), false) AS negated
        FROM (SELECT id, lower(job_description) AS low, strpos(lower(job_description), lower(required_skills[-1])) AS k FROM jobs)""",
    "t14_clean_skill": f"SELECT s, {cleaned('s')} AS skill FROM {_SKILL_ROWS}",
    "t15_printable": "SELECT id, regexp_replace(job_title, '[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}" + "".join(f"\\x{{{ord(c):X}}}" for c in _WESTERN) + "]', '?', 'g') AS title FROM jobs",
    "t16_split": f"""SELECT id, CASE WHEN len(p) > 0 THEN array_to_string(p, '|') END AS parts FROM (SELECT id, list_filter(list_transform(string_split(location, ','), lambda s: {strip('s')}), lambda s: s <> '') AS p FROM jobs)""",
    "t17_titles": r"""SELECT id, array_to_string(list_transform(regexp_extract_all(job_title, '\p{L}+|[^\p{L}]+'), lambda s: upper(left(s, 1)) || lower(substr(s, 2))), '') AS title FROM jobs""",
    "t18_markdown": f"""SELECT id, regexp_replace({strip("regexp_replace('" + '"**' + "' || company_name || '" + '**" ' + "', '\\*\\*|__', '', 'g')")}, '^["''`]+|["''`]+$', '', 'g') AS plain FROM jobs""",
    "t19_voice": f"SELECT doc_id, {voice('text')} AS voice FROM documents",
    "t20_contacts": r"""SELECT doc_id, regexp_extract(coalesce(text, ''), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+') AS email,
        regexp_replace(regexp_extract(coalesce(text, ''), '\+?1?\s*[-.]?\s*\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}'), '^\s+|\s+$', '', 'g') AS phone,
        regexp_extract(coalesce(text, ''), '(?i)linkedin\.com/in/[\w-]+') AS linkedin, regexp_extract(coalesce(text, ''), '(?i)github\.com/[\w-]+') AS github FROM documents""",
    "t23_json_or_text": """SELECT id, CASE WHEN json_valid(score_breakdown) AND json_type(score_breakdown) = 'VARCHAR' THEN score_breakdown::JSON->>'$' ELSE score_breakdown END AS value, score_breakdown AS unquoted FROM tailored_resumes""",
    "r08_posted_dates": """SELECT id, CASE source WHEN 'jobharbor' THEN DATE '2026-01-19' - n::INT WHEN 'hirewell' THEN DATE '2026-01-19' - (7 * floor(n / 7))::INT
        WHEN 'tasknest' THEN DATE '2026-01-19' - (30 * floor(n / 30))::INT ELSE date_posted END AS posted FROM (SELECT id, source, date_posted, datediff('day', date_posted, DATE '2026-01-19') AS n FROM jobs)""",
    "r09_salaries": f"SELECT id, CASE WHEN lower({strip('salary_range')}) NOT IN ({', '.join(map(q, NO_SALARY))}) THEN {strip('salary_range')} END AS salary FROM jobs",
    "p13_resume_parts": f"""WITH {PARTS} SELECT m.id, coalesce(len(positions), 0)::INT AS n_positions, coalesce(len(skills), 0)::INT AS n_skills, coalesce(len(certs), 0)::INT AS n_certs,
        coalesce(len(projects), 0)::INT AS n_projects, coalesce(len(bullets), 0)::INT AS n_bullets, summary IS NOT NULL AS has_summary FROM master_resumes m LEFT JOIN bul USING (id)""",
    "n03_json_keys": f"WITH {MASTERS} SELECT id, array_to_string(json_keys(j), '|') AS sections FROM r",
    "k07_printable": f"WITH {MASTERS} SELECT id, coalesce(length({strip("j->>'$.personal_info.name'")}) > 0 AND length({strip("j->>'$.personal_info.email'")}) > 0, false) AS ok FROM r",
    "c01_skill_match": f"""WITH {PAIRS}, {match('pairs')} SELECT tailored_id, {SCORE} AS score, CASE WHEN asked THEN {_LIST.format(a='list_sort(list_intersect(a, b))')} ELSE '' END AS matched,
        CASE WHEN asked THEN len({_MINUS.format(a='a', b='b')}) ELSE 0 END::INT AS n_missing, CASE WHEN asked THEN len({_MINUS.format(a='b', b='a')}) ELSE 0 END::INT AS n_additional,
        CASE WHEN asked THEN len(a) ELSE 0 END::INT AS n_job, CASE WHEN asked THEN len(b) ELSE len(resume_skills) END::INT AS n_resume FROM m""",
    "a20_weighted_match": f"""WITH {PAIRS}, {match('pairs')}, w AS (SELECT tailored_id, asked, list_sum(list_transform(a, lambda s: CASE WHEN s IN ('python', 'sql') THEN 2.0 ELSE 1.0 END))::DOUBLE AS total,
        coalesce(list_sum(list_transform(list_intersect(a, b), lambda s: CASE WHEN s IN ('python', 'sql') THEN 2.0 ELSE 1.0 END)), 0)::DOUBLE AS got FROM m)
        SELECT tailored_id, round(CASE WHEN asked AND total > 0 THEN got / total * 100 ELSE 0 END, 6) AS score FROM w""",
    "a21_category_match": f"""WITH {PAIRS}, e AS (SELECT tailored_id, {expanded('required_skills')} AS a, {expanded('preferred_skills')} AS p, {expanded('resume_skills')} AS b FROM pairs),
        cs AS (SELECT tailored_id, list_filter([CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) * 100.0 END, CASE WHEN len(p) > 0 THEN len(list_intersect(p, b)) / len(p) * 100.0 END], lambda x: x IS NOT NULL) AS v FROM e)
        SELECT tailored_id, round(CASE WHEN len(v) > 0 THEN list_sum(v) / len(v) ELSE 0 END, 6) AS score FROM cs""",
    "c03_education_rank": f"""WITH {SKILLS}, low AS (SELECT resume_id, list_transform(coalesce(resume_skills, []::VARCHAR[]), lambda s: lower(s)) AS l FROM rs) SELECT resume_id,
        CASE WHEN list_has_any(l, ['phd', 'ph.d', 'doctorate']) THEN 4 WHEN list_has_any(l, ['master', 'masters', 'm.s.', 'ms', 'mba']) THEN 3
        WHEN list_has_any(l, ['bachelor', 'bachelors', 'b.s.', 'bs', 'undergraduate']) THEN 2 WHEN list_has_any(l, ['associate']) THEN 1 ELSE 0 END AS rank FROM low""",
    "c04_skill_gap": f"""WITH {PAIRS}, h AS (SELECT tailored_id, coalesce(required_skills, []::VARCHAR[]) AS a, coalesce(preferred_skills, []::VARCHAR[]) AS p,
        list_transform(coalesce(resume_skills, []::VARCHAR[]), lambda r: lower({strip('r')})) AS have FROM pairs),
        g AS (SELECT tailored_id, a, list_filter(a, lambda s: NOT {gap_hit('s', 'have')}) AS miss, list_filter(p, lambda s: NOT {gap_hit('s', 'have')}) AS pm FROM h)
        SELECT tailored_id, {_LIST.format(a='miss')} AS missing, len(pm)::INT AS n_missing_preferred, CASE WHEN len(a) > 0 THEN round((len(a) - len(miss)) / len(a) * 100, 1) ELSE 100.0 END AS match_percentage,
        {_LIST.format(a='miss[1:5]')} AS first_gaps FROM g""",
    "j06_score_for_active": f"WITH {SKILLS}, one AS (SELECT j2.id, j2.required_skills, rs.resume_skills FROM jobs j2, rs WHERE rs.resume_id = (SELECT min(id) FROM master_resumes WHERE is_active)), {match('one')} SELECT id, {SCORE} AS score FROM m",
    "c12_candidates": f"""WITH {SKILLS}, own AS (SELECT domain, max(id) AS k FROM master_resumes WHERE NOT is_sample AND domain IS NOT NULL GROUP BY domain),
        adv AS (SELECT jb.*, coalesce(own.k, (SELECT min(id) FROM master_resumes WHERE is_active)) AS resume_id FROM jobs jb LEFT JOIN own ON own.domain = jb.domain
          WHERE status = 'analyzed' AND NOT EXISTS (SELECT 1 FROM tailored_resumes t WHERE t.job_id = jb.id)),
        {facts('adv')}, src AS (SELECT adv.id, resume_id, {_LISTED}, asked, level, resume_skills FROM adv JOIN facts USING (id) JOIN rs USING (resume_id)), {score('src')}
        SELECT id, resume_id, total AS score FROM scored WHERE total >= 35""",
    "c02_match_score": f"""WITH {SKILLS}, adv AS (SELECT * FROM jobs WHERE id IN (SELECT job_id FROM tailored_resumes)), {facts('adv')},
        src AS (SELECT t.id AS tailored_id, {_LISTED}, asked, level, resume_skills FROM tailored_resumes t JOIN adv ON adv.id = t.job_id JOIN facts ON facts.id = t.job_id JOIN rs ON rs.resume_id = t.master_resume_id), {score('src')}
        SELECT tailored_id, total, round(q, 2) AS required, round(p, 2) AS preferred, round(e, 2) AS experience, round(d, 2) AS education, round(bonus, 2) AS bonus FROM scored""",
    "c11_analysis": f"""WITH {SKILLS}, adv AS (SELECT * FROM jobs WHERE status = 'new' AND length(trim(job_description)) > 0), {facts('adv')},
        src AS (SELECT id, req, pref, asked, level, resume_skills FROM facts, rs WHERE rs.resume_id = (SELECT min(id) FROM master_resumes WHERE is_active)), {score('src')}, {domain('adv', 'job_title', 'job_description', 'id')}
        SELECT id, len(req)::INT AS n_required, len(pref)::INT AS n_preferred, CASE WHEN clear THEN d2.d ELSE 'other' END AS domain, round(total, 1) AS match_score, 'analyzed' AS status FROM scored JOIN (SELECT id, clear, d FROM dom) d2 USING (id)""",
    "r02_experience": f"WITH {_DEMANDING}, {x.experience('dj', 'id', 'text')} SELECT id, skill, years, is_minimum FROM exp",
    "r03_education": f"WITH {x.education('documents', 'doc_id', 'text')} SELECT doc_id, level, field, is_required FROM edu",
    "r04_certificates": f"WITH {_DEMANDING}, {x.certificates('dj', 'id', 'text')} SELECT id, name, is_required FROM cert",
    "r05_requirements": f"""WITH {_DEMANDING}, {x.experience('dj', 'id', 'text')}, {x.education('dj', 'id', 'text')}, {x.certificates('dj', 'id', 'text')},
        e AS (SELECT id, min(years) AS a, max(years) AS b FROM exp GROUP BY id), d AS (SELECT id, arg_max(level, {x.RANK} - place / 1000.0) AS level, count(*) AS n FROM edu GROUP BY id), c AS (SELECT id, count(*) AS n FROM cert GROUP BY id)
        SELECT j.id, coalesce(a, 0)::INT AS min_years, coalesce(b, 0)::INT AS max_years, level, coalesce(d.n, 0)::INT AS n_levels, coalesce(c.n, 0)::INT AS n_certificates FROM jobs j LEFT JOIN e USING (id) LEFT JOIN d USING (id) LEFT JOIN c USING (id)""",
    "r11_resume_text": f"""WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM documents WHERE doc_type = 'resume' AND text IS NOT NULL),
        u AS (SELECT doc_id, trim(line) AS line, k FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM l) WHERE trim(line) <> ''),
        h AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(line, {q('(?i)^(?:' + p + ')[ ]*:?$')}) THEN {q(n)}" for n, p in x.RESUME_HEADS.items())} END AS head FROM u),
        s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), 'head') AS section FROM h)
        SELECT doc_id, section, count(*)::INT AS n_lines FROM s WHERE head IS NULL GROUP BY doc_id, section""",
    "r06_phrases": f"WITH {phrases('jobs', 'id', 'job_description', SKILL_NAMES)} SELECT id, phrase, ofs AS place FROM hit",
    "r07_skills": f"WITH {facts('jobs')} SELECT id, array_to_string(list_sort(req), '|') AS required, array_to_string(list_sort(pref), '|') AS preferred FROM facts",
    "a29_by_category": f"""WITH {phrases('jobs', 'id', 'job_description', _KEYWORDS)}, k AS (SELECT id, category, list(DISTINCT phrase ORDER BY phrase) AS l FROM hit GROUP BY id, category)
        SELECT id, category, len(l)::INT AS n, array_to_string(l[1:15], ', ') AS keywords FROM k""",
    "c11b_flat_analysis": f"""WITH {phrases('jobs', 'id', 'job_description', _KEYWORDS)}, k AS (SELECT id, list(DISTINCT phrase ORDER BY phrase) FILTER (category <> 'soft_skills') AS r, list(DISTINCT phrase ORDER BY phrase) FILTER (category = 'soft_skills') AS p FROM hit GROUP BY id)
        SELECT j.id, CASE WHEN job_description IS NOT NULL THEN coalesce(array_to_string(r, '|'), '') END AS required, CASE WHEN job_description IS NOT NULL THEN coalesce(array_to_string(p, '|'), '') END AS preferred FROM jobs j LEFT JOIN k USING (id)""",
    "r01_sections": f"WITH {sections('documents', 'doc_id', 'text')} SELECT doc_id, required, preferred FROM sec",
    "c05_domains": f"WITH {domain('jobs', 'job_title', 'job_description', 'id')} SELECT id, CASE WHEN clear THEN d ELSE 'other' END AS domain, CASE WHEN clear THEN round(best / total, 4) ELSE 0.0 END AS confidence, best::INT AS best, total::INT AS total FROM dom",
    "c06_resume_domains": f"""WITH {PARTS}, src AS (SELECT m.id, array_to_string(list_filter(list_transform(positions, lambda x: x->>'$.title'), lambda t: t IS NOT NULL), ' ') AS tt,
        concat_ws(' ', summary, array_to_string(bullets, ' '), array_to_string(skills, ' ')) AS bb FROM master_resumes m LEFT JOIN bul USING (id)), {domain('src', 'tt', 'bb', 'id')}
        SELECT id, CASE WHEN clear THEN d ELSE 'other' END AS domain FROM dom""",
    "c07_document_kinds": f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents), y AS (SELECT doc_id, ({_signs(RESUME_SIGNS)})::INT AS yes, ({_signs(OTHER_SIGNS)})::INT AS no,
        regexp_matches(t, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') AS e, regexp_matches(t, '\\+?1?\\s*[-.]?\\s*\\(?[0-9]{{3}}\\)?[\\s.-]?[0-9]{{3}}[\\s.-]?[0-9]{{4}}') AS p FROM x),
        z AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(yes * 0.15::DOUBLE, 0.6::DOUBLE) + CASE WHEN e THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN p THEN 0.1::DOUBLE ELSE 0 END - least(no * 0.25::DOUBLE, 0.75::DOUBLE))), 4) AS c FROM y)
        SELECT doc_id, CASE WHEN no >= 2 THEN 'not_resume' WHEN c >= 0.7::DOUBLE THEN 'resume' WHEN c <= 0.3::DOUBLE THEN 'not_resume' ELSE 'inconclusive' END AS verdict, c AS confidence, yes AS n_resume, no AS n_other, CASE WHEN no < 2 AND c >= 0.7::DOUBLE THEN 'resume' ELSE 'not_resume' END AS ends_as FROM z""",
    "c08_style": f"""WITH {PARTS}, b AS (SELECT m.id, concat_ws(' ', summary, array_to_string(coalesce(bullets, []::VARCHAR[]), ' ')) AS body, coalesce(bullets, []::VARCHAR[]) AS bs FROM master_resumes m LEFT JOIN bul USING (id)),
        w AS (SELECT *, list_transform(bs, lambda x: len({_WORDS_OF.format(c='x')})) AS ws, {', '.join(f"len(list_filter(bs, lambda x: {o}))::INT AS n{i}" for i, o in enumerate(_OPENS.values()))},
          list_filter(list_transform(bs, lambda x: left({_BARE}, 1)), lambda l: l <> '') AS letters FROM b),
        v AS (SELECT *, CASE WHEN len(ws) > 0 THEN list_sum(ws) / len(ws) ELSE 0 END AS mean, CASE WHEN len(bs) > 0 THEN len(list_filter(bs, lambda x: regexp_matches(x, '[0-9]'))) / len(bs) ELSE 0 END AS ratio, greatest(n0, n1, n2, n3, n4) AS most FROM w)
        SELECT id, {voice('body')} AS voice, CASE WHEN len(ws) = 0 OR (mean > 12 AND mean <= 20) THEN 'moderate' WHEN mean <= 12 THEN 'punchy' ELSE 'detailed' END AS sentences, round(mean, 1) AS avg_words,
        coalesce(list_min(ws), 0)::INT AS min_words, coalesce(list_max(ws), 0)::INT AS max_words, CASE WHEN ratio > 0.4 THEN 'heavy' WHEN ratio >= 0.2 THEN 'moderate' ELSE 'light' END AS metric_density, round(ratio, 4) AS metric_ratio,
        CASE {' '.join(f"WHEN most > 0 AND n{i} = most THEN {q(ch)}" for i, ch in enumerate(BULLETS))} ELSE 'none' END AS bullet_char,
        CASE WHEN len(letters) = 0 OR len(list_filter(letters, lambda l: regexp_matches(l, '\\p{{Lu}}'))) / len(letters) > 0.8 THEN 'upper' ELSE 'lower' END AS capitalization,
        len(bs) > 0 AND len(list_filter(bs, lambda x: suffix(regexp_replace(x, '\\s+$', ''), '.'))) / len(bs) > 0.6 AS trailing_period, len(bs)::INT AS n_bullets FROM v""",
    "o10_section_order": f"WITH {PARTS} SELECT m.id, {ordered('j', SECTIONS)} AS sections FROM master_resumes m LEFT JOIN parts USING (id)",
    "c09_bullet_checks": f"""WITH {_CHANGED}, w AS (SELECT id, position, place, {warnings(*BULLET_WORDS, True)} AS w FROM changed WHERE original <> modified)
        SELECT id, position, place, coalesce(array_to_string(w, '|'), '') AS warnings, len(w) = 0 AS is_valid, greatest(0, 100 - 20 * len(w))::INT AS score FROM w""",
    "c10_resume_checks": f"""WITH {_CHANGED}, w AS (SELECT id, count(*) AS n, count(*) FILTER (len({warnings(*BULLET_WORDS, True)}) = 0) AS ok FROM changed WHERE original <> modified GROUP BY id),
        sv AS (SELECT id, len({warnings(*SUMMARY_WORDS, False)}) = 0 AS ok FROM (SELECT id, words, summary AS original, new_summary AS modified FROM both_sides WHERE length(summary) > 0 AND length(new_summary) > 0 AND summary <> new_summary))
        SELECT b.id, coalesce(n, 0) AS n_checked, coalesce(w.ok, 0) AS n_valid, sv.ok AS summary_valid, n_new_skills < n_skills AS fewer_skills, coalesce(n = w.ok, true) AND coalesce(sv.ok, true) AND n_new_skills >= n_skills AS is_valid
        FROM both_sides b LEFT JOIN w USING (id) LEFT JOIN sv USING (id)""",
    "c15_tailoring": f"""WITH {_TAILORING} SELECT id, {_LIST.format(a='listed[1:5]')} AS first_skills, len(listed)::INT AS n_skills,
        {_LIST.format(a="list_transform(list_sort(list_transform(projects, lambda p, i: {'r': -" + kw_hits("concat_ws(' ', coalesce(p->>'$.name', ''), coalesce(p->>'$.description', ''), array_to_string(" + strings("CASE WHEN coalesce(json_type(p->'$.technologies'), 'NULL') = 'NULL' THEN p->'$.tech' ELSE p->'$.technologies' END") + ", ' '))") + ", 'i': i, 'n': coalesce(p->>'$.name', '')}))[1:3], lambda z: z.n)")} AS projects,
        {_LIST.format(a="list_transform(list_sort(list_transform(list_sort(list_transform(bullets, lambda t, i: {'r': -" + kw_hits('t') + ", 'i': i}))[1:3], lambda z: z.i)), lambda i: (i - 1)::VARCHAR)")} AS bullet_places,
        coverage_before, coverage_after, round(coverage_after - coverage_before, 1) AS improvement, n_rejected::INT AS n_rejected,
        coalesce(list_sum(list_transform(olds, lambda x: CASE WHEN len({_YEARS}) >= 2 THEN abs({_YEARS}[-1]::INT - {_YEARS}[1]::INT) ELSE 0 END)), 0)::INT AS years,
        {ordered("j", ("personal_info", "professional_summary", "work_experience", "skills", "education", "certifications", "projects"))} AS sections FROM x7""",
    "j10_bullet_pairs": f"WITH {_CHANGED} SELECT id, position, place, original = modified AS same FROM changed",
    "o04_skill_order": f"""WITH {PAIRS}, x AS (SELECT tailored_id, coalesce(resume_skills, []::VARCHAR[]) AS r, list_transform(coalesce(required_skills, []::VARCHAR[]), lambda s: lower(s)) AS w FROM pairs)
        SELECT tailored_id, {_LIST.format(a="list_concat(list_filter(r, lambda s: list_contains(w, lower(s))), list_filter(r, lambda s: NOT list_contains(w, lower(s))))")} AS skills FROM x""",
    "a24_years": f"""WITH {PARTS} SELECT m.id, coalesce(list_sum(list_transform(positions, lambda x: CASE WHEN len({_YEARS}) >= 2 THEN abs({_YEARS}[-1]::INT - {_YEARS}[1]::INT) ELSE 0 END)), 0)::INT AS years
        FROM master_resumes m LEFT JOIN parts USING (id)""",
    "w03_offered_load": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS n_window FROM events",
    "w03_admissions": """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
        s AS (SELECT event_type, event_id, n, t AS admitted_at, [t] AS recent FROM e WHERE n = 1
          UNION ALL SELECT event_type, event_id, n, a, list_append(CASE WHEN len(recent) >= 3 THEN recent[2:] ELSE recent END, a)
          FROM (SELECT e.*, recent, greatest(e.t, recent[-1], CASE WHEN len(recent) >= 3 THEN recent[1] + 3600000001 ELSE 0 END) AS a FROM s JOIN e ON e.event_type = s.event_type AND e.n = s.n + 1))
        SELECT event_type, event_id, admitted_at FROM s""",
    "w04_daily_quota": """SELECT event_id, n::INT AS n_today, n <= 5 AS admitted, greatest(0, 5 - n)::INT AS "left" FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events)""",
    "w05_quota_use": "SELECT event_type, (ts::DATE)::VARCHAR AS day, round(count(*) / 50 * 100, 1) AS used_percentage, 50 - count(*) <= 5 AS low FROM events GROUP BY event_type, ts::DATE",
    "a13_capped_sum": "SELECT user_id, round(least(sum(value), 100.0), 6) AS score FROM events GROUP BY user_id",
    "a14_score_share": """SELECT user_id, share, CASE WHEN share >= 85 THEN 'strong_yes' WHEN share >= 70 THEN 'yes' WHEN share >= 50 THEN 'maybe' ELSE 'no' END AS advice
        FROM (SELECT user_id, round(sum(least(floor(abs(value)), 10)) / (count(*) * 10) * 100, 1) AS share FROM events GROUP BY user_id)""",
    "a25_tokens": "SELECT role, sum(length(coalesce(content, '')) // 4)::BIGINT AS n_tokens FROM chat_messages GROUP BY role",
    "d04_durations": "SELECT session_id, round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e4::DOUBLE) / 100 AS seconds FROM chat_messages WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY session_id",
    "c18_log_summary": f"""WITH {_LOG} SELECT count(*) FILTER (contains(line, 'ERROR')) AS errors, count(*) FILTER (contains(line, 'WARNING')) AS warnings,
        count(*) FILTER (contains(line, 'ERROR') AND (contains(line, '429') OR contains(lower(line), 'quota'))) AS quota_errors,
        sum(coalesce(TRY_CAST(regexp_extract(line, '([0-9]+) saved,', 1) AS INT), 0))::BIGINT AS saved, sum(coalesce(TRY_CAST(regexp_extract(line, '([0-9]+) updated,', 1) AS INT), 0))::BIGINT AS updated FROM log""",
    "a16_task_counts": f"""WITH {_LOG}, x AS (SELECT coalesce(nullif(regexp_extract(line, 'Job ''(\\w+)'' OK', 1), ''), nullif(regexp_extract(line, '\\[(\\w+)\\] (?:Starting|Generating)', 1), '')) AS task, contains(line, ''' OK') AS ok FROM log)
        SELECT task, count(*) FILTER (NOT ok) AS started, count(*) FILTER (ok) AS ended FROM x WHERE task IS NOT NULL GROUP BY task""",
    "k01_upsert": """WITH j AS (SELECT *, coalesce(date_scraped < TIMESTAMPTZ '2025-07-01 00:00:00+00', false) AS early FROM jobs),
        o AS (SELECT * FROM j WHERE early QUALIFY row_number() OVER (PARTITION BY application_url ORDER BY id DESC) = 1),
        n AS (SELECT * REPLACE (CASE WHEN early THEN '' ELSE salary_range END AS salary_range) FROM j QUALIFY row_number() OVER (PARTITION BY application_url ORDER BY id DESC) = 1)
        SELECT coalesce(o.id, n.id) AS id, n.application_url, n.job_title, coalesce(nullif(n.salary_range, ''), o.salary_range) AS salary_range, coalesce(o.status, 'new') AS status, o.id IS NULL AS is_new FROM n LEFT JOIN o USING (application_url)""",
    "k02_batch": f"""WITH {_HALVES}, nn AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY application_url ORDER BY id DESC) = 1)
        SELECT coalesce(o.id, n.id) AS id, coalesce(n.application_url, o.application_url) AS application_url, coalesce(n.job_title, o.job_title) AS job_title, coalesce(o.status, 'new') AS status, o.id IS NULL AS is_new FROM nn n FULL JOIN o USING (application_url)""",
    "k02_outcomes": f"""WITH {_HALVES}, c AS (SELECT application_url, count(*) AS n, bool_or(application_url IN (SELECT application_url FROM o)) AS known FROM v GROUP BY 1)
        SELECT 'saved' AS outcome, count(*) FILTER (NOT known) AS n_postings FROM c UNION ALL SELECT 'updated', (sum(n) - count(*) FILTER (NOT known))::BIGINT FROM c
        UNION ALL SELECT 'failed', (SELECT count(*) FROM jobs) - (SELECT count(*) FROM v)""",
    "u03_merged_skills": f"""WITH x AS (SELECT id, coalesce(required_skills, []::VARCHAR[]) AS o, {_MERGE_NEW} AS n FROM jobs), y AS (SELECT id, o, n, {_LOWERED.format(a='o')} AS ol, {_LOWERED.format(a='n')} AS nl FROM x)
        SELECT id, array_to_string(CASE WHEN len(n) = 0 THEN CASE WHEN len(o) > 0 THEN o END WHEN len(o) = 0 THEN n ELSE list_concat(o, list_filter(n, lambda s, i: NOT list_contains(ol, lower(s)) AND list_position(nl, lower(s)) = i)) END, '|') AS skills FROM y""",
    "k03_tailored": """SELECT id + 1000000000 AS id, job_id, master_resume_id, match_score / 2 AS match_score FROM tailored_resumes""",
    "c13_archive": "SELECT id, CASE WHEN date_scraped < TIMESTAMPTZ '2025-12-20 00:00:00+00' AND status NOT IN ('applied', 'archived') THEN 'archived' ELSE status END AS status FROM jobs",
    "k11_ledger": """SELECT role AS model, strftime(make_timestamp(epoch_us(created_at)), '%Y-%m') AS day, count(*) + 1 AS n_calls, (sum(length(coalesce(content, '')) // 4) + 10)::BIGINT AS n_tokens
        FROM chat_messages WHERE role IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2""",
    "a27_best_phrase": "SELECT job_title, id FROM jobs WHERE job_title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_title ORDER BY match_score DESC NULLS LAST, id) = 1",
}
