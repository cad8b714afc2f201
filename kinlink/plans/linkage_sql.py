"""SQL of the rules of normalisation, blocking and pair features, by which the Spark plans are checked.

Common table expressions over e (records) of the entity adapter. They follow the rules as they are written down for
single records and share nothing with the Spark expressions but the fixed values.
"""

from __future__ import annotations

from ..functions import vocabulary as V


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


_LEGAL, _STOP, _ABBR = _list(V.LEGAL_FORMS), _list(V.STOPWORDS), _map(V.ABBREVIATIONS)
FORMS = "|".join(sorted(V.LEGAL_FORMS, key=len, reverse=True))
CLEAN = r"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
WORDS = "list_filter(string_split({x}, ' '), lambda w: w <> '')"
_BARE = f"list_filter({{x}}, lambda w: NOT list_contains({_LEGAL}, upper(w)))"
_DIST = f"list_filter({{x}}, lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
_DISTINCT_RUN = "array_to_string(list_transform(list_filter(range(1, length({x}) + 1), lambda i: i = 1 OR substr({x}, i, 1) <> substr({x}, i - 1, 1)), lambda i: substr({x}, i, 1)), '')"
_SORTED = "list_sort(list_distinct({x}))"
_SHORT_FIRST = "list_transform(list_sort(list_transform({x}, lambda v: {{'n': length(v), 'v': v}})), lambda s: s.v)"


def grams(x: str, n: int) -> str:
    return f"list_sort(list_distinct(CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN length({x}) < {n} THEN [{x}] ELSE list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})) END))"


def _digraphs(x: str) -> str:
    for a, b in V.DIGRAPHS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_HONORIFIC = V.HONORIFICS
_IN = _list(V.NO_HOUSE_PREFIX)

#: Names: nf has a row a record with all derived fields of the name.
NAMES = rf"""
n1 AS (SELECT entity_id, source, coalesce(country, 'UNKNOWN') AS country, coalesce(trim(business_name), '') AS name_raw, coalesce(trim(business_address), '') AS addr_raw FROM e),
n2 AS (SELECT *, strip_accents(lower(name_raw)) AS name_ascii, trim(regexp_replace(name_raw, '(?i){_HONORIFIC}', '')) AS stripped, lower(name_raw) AS low FROM n1),
n3 AS (SELECT *, {CLEAN.format(x="name_ascii")} AS name_alnum, CASE WHEN stripped <> '' AND lower(stripped) <> low THEN stripped END AS name_no_honorific,
    trim(regexp_replace(trim(regexp_replace(low, '{V.DOMAIN_PHONE}', '', 'g')), '{V.DOMAIN_TITLE}', '')) AS site FROM n2),
n4 AS (SELECT *, {WORDS.format(x="name_alnum")} AS name_tokens, {WORDS.format(x=CLEAN.format(x="strip_accents(lower(coalesce(name_no_honorific, '')))"))} AS honorific_words,
    replace(CASE WHEN regexp_matches(site, '{V.DOMAIN_WHOLE}') THEN regexp_extract(site, '{V.DOMAIN_WHOLE}', 1) ELSE regexp_extract(site, '{V.DOMAIN_INSIDE}', 1) END, '-', '') AS body FROM n3),
n5 AS (SELECT *, {_BARE.format(x="name_tokens")} AS bare, {_DIST.format(x=_BARE.format(x="honorific_words"))} AS honorific_distinctive, CASE WHEN length(body) >= 3 THEN body END AS domain_clean FROM n4),
n6 AS (SELECT *, {_DIST.format(x="bare")} AS distinctive FROM n5),
chars AS (SELECT entity_id, i, substr(t, i, 1) AS c FROM (SELECT entity_id, replace(name_raw, 'ॐ', ' om ') AS t, unnest(range(1, length(replace(name_raw, 'ॐ', ' om ')) + 1)) AS i FROM n1 WHERE regexp_matches(name_raw, '[\x{{0900}}-\x{{0D7F}}]'))),
moved AS (SELECT entity_id, i, CASE WHEN {" OR ".join(f"ord(c) BETWEEN {b} AND {b + 127}" for b in V.BLOCKS.values())} THEN chr(CAST(2304 + ord(c) % 128 AS INT)) ELSE c END AS c FROM chars),
context AS (SELECT *, coalesce(lag(c) OVER w, ' ') AS p, coalesce(lead(c) OVER w, ' ') AS x, {_map(V.CONSONANTS)} AS con, {_map(V.VOWELS)} AS vow, {_map(V.MATRAS)} AS mat FROM moved WINDOW w AS (PARTITION BY entity_id ORDER BY i)),
latin AS (SELECT entity_id, i, CASE
    WHEN con[c] IS NOT NULL THEN con[c] || CASE WHEN con[x] IS NOT NULL OR vow[x] IS NOT NULL THEN 'a' ELSE '' END
    WHEN vow[c] IS NOT NULL THEN vow[c]
    WHEN mat[c] IS NOT NULL THEN CASE WHEN con[p] IS NOT NULL THEN mat[c] ELSE c END
    WHEN ord(c) IN (2305, 2306) THEN CASE WHEN con[p] IS NOT NULL THEN 'an' ELSE 'n' END
    WHEN ord(c) = 2307 THEN CASE WHEN con[p] IS NOT NULL THEN 'ah' ELSE 'h' END
    WHEN ord(c) = 2381 THEN ''
    WHEN ord(c) BETWEEN 2406 AND 2415 THEN CAST(ord(c) - 2406 AS VARCHAR)
    ELSE c END AS l FROM context),
translit AS (SELECT entity_id, trim(regexp_replace(string_agg(l, '' ORDER BY i), '\s+', ' ', 'g')) AS name_transliterated FROM latin GROUP BY entity_id),
n7 AS (SELECT n6.*, coalesce(t.name_transliterated, '') AS name_transliterated, {_DIST.format(x=_BARE.format(x=WORDS.format(x=CLEAN.format(x="lower(coalesce(t.name_transliterated, ''))"))))} AS translit_distinctive FROM n6 LEFT JOIN translit t USING (entity_id)),
terms AS (SELECT entity_id, 'n' AS kind, unnest(distinctive) AS tok, generate_subscripts(distinctive, 1) AS pos FROM n7 UNION ALL SELECT entity_id, 't', unnest(translit_distinctive), generate_subscripts(translit_distinctive, 1) FROM n7),
sound1 AS (SELECT *, {_digraphs("tok")} AS s, translate(upper(tok), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077') AS d FROM terms WHERE kind = 't' OR length(tok) >= 3),
sound2 AS (SELECT *, substr(s, 1, 1) || regexp_replace(substr(s, 2), '[aeiouy]', '', 'g') AS s2, replace(substr(d, 1, 1), '7', '0') || replace(substr(d, 2), '7', '') AS d2 FROM sound1),
sound3 AS (SELECT *, {_DISTINCT_RUN.format(x="s2")} AS skeleton, {_DISTINCT_RUN.format(x="d2")} AS d3 FROM sound2),
sounds AS (SELECT entity_id, list(skeleton ORDER BY pos) FILTER (kind = 'n') AS phonetic, list(skeleton ORDER BY pos) FILTER (kind = 't') AS translit_phonetic,
    list(upper(substr(tok, 1, 1)) || substr(replace(substr(d3, 2), '0', '') || '000', 1, 3) ORDER BY pos) FILTER (kind = 'n' AND regexp_matches(tok, '^[a-z]+$')) AS soundex_tokens FROM sound3 GROUP BY entity_id),
nf AS (SELECT n7.entity_id, source, country, name_raw, addr_raw, name_alnum, name_tokens, array_to_string(list_sort(name_tokens), ' ') AS name_tokens_sorted, array_to_string(bare, ' ') AS name_no_suffix,
    array_to_string(list_sort(bare), ' ') AS name_no_suffix_sorted, array_to_string(list_transform(name_tokens, lambda w: substr(w, 1, 1)), '') AS name_initials, distinctive, honorific_distinctive, name_no_honorific,
    domain_clean, name_transliterated, translit_distinctive, coalesce(phonetic, []) AS phonetic, coalesce(translit_phonetic, []) AS translit_phonetic, coalesce(soundex_tokens, []) AS soundex_tokens,
    regexp_extract_all(upper(name_ascii), '\b(?:{FORMS})\b') AS legal_suffixes, array_to_string(list_transform(name_tokens, lambda w: lower(coalesce({_ABBR}[upper(w)], w))), ' ') AS name_abbrev_expanded,
    CASE WHEN len(distinctive) >= 2 THEN array_to_string(distinctive, '') ELSE '' END AS name_concat_distinctive, {grams("name_alnum", 3)} AS name_c3, {grams("name_alnum", 4)} AS name_c4, {grams("name_alnum", 5)} AS name_c5
    FROM n7 LEFT JOIN sounds USING (entity_id))"""

_SLASH = rf"(?:\b|[a-z])({V.SLASH_NUMBERS})\b"

#: Addresses: af has a row a record with all derived fields of the address.
ADDRESSES = rf"""
a1 AS (SELECT entity_id, country, addr_raw, lower(addr_raw) AS low, regexp_extract_all(upper(strip_accents(lower(addr_raw))), '[\p{{L}}\p{{N}}_]+') AS spoken FROM n1),
a2 AS (SELECT *, {CLEAN.format(x=f"lower(array_to_string(list_transform(spoken, lambda w: coalesce({_ABBR}[w], w)), ' '))")} AS addr_alnum,
    list_transform(regexp_extract_all(low, '{_SLASH}', 1), lambda v: string_split(replace(v, '-', '/'), '/')) AS parts,
    list_filter(list_zip(regexp_extract_all(low, '{V.HOUSE_LETTER}', 1), regexp_extract_all(low, '{V.HOUSE_LETTER}', 2)), lambda z: NOT list_contains({_IN}, z[1])) AS pairs,
    list_filter(list_zip(regexp_extract_all(low, '{V.HOUSE_WORDS}', 1), regexp_extract_all(low, '{V.HOUSE_WORDS}', 2)), lambda z: length(regexp_replace(z[2], '[^a-z0-9]', '', 'g')) BETWEEN 1 AND 10) AS said FROM a1),
a3 AS (SELECT *, {WORDS.format(x="addr_alnum")} AS addr_tokens, list_concat(list_concat(regexp_extract_all(low, '\b\d+\b'), regexp_extract_all(low, '{V.NUMBER_AFTER}', 2)), flatten(parts)) AS plain,
    {_SORTED.format(x="list_concat(list_transform(parts, lambda p: array_to_string(p, '_')), list_transform(parts, lambda p: array_to_string(p, '')))")} AS slash_compounds,
    list_transform(said, lambda z: regexp_replace(z[2], '[^a-z0-9]', '', 'g')) AS values_said FROM a2),
a4 AS (SELECT *, {_SORTED.format(x="list_concat(list_transform(pairs, lambda z: z[1] || z[2]), list_concat(values_said, list_transform(list_zip(said, values_said), lambda z: z[1][1] || '_' || z[2])))")} AS house_tokens,
    {_SHORT_FIRST.format(x="list_distinct(list_filter(list_concat(list_concat(plain, list_transform(plain, lambda v: ltrim(v, '0'))), list_concat(list_transform(pairs, lambda z: z[2]), flatten(list_transform(said, lambda z: regexp_extract_all(z[2], '[0-9]+'))))), lambda v: v <> ''))")} AS numeric_atoms FROM a3),
af AS (SELECT entity_id, addr_alnum, addr_tokens, array_to_string(list_sort(addr_tokens), ' ') AS addr_tokens_sorted, slash_compounds, house_tokens, numeric_atoms,
    CASE {" ".join(f"WHEN country = '{k}' THEN regexp_extract_all(addr_raw, '{chr(92)}b{v}{chr(92)}b')[-1]" for k, v in V.POSTAL_CODES.items())} ELSE regexp_extract_all(addr_raw, '\b{V.OTHER_POSTAL_CODE}\b')[-1] END AS postal_code,
    CASE WHEN regexp_matches(addr_tokens[1], '^\d+[a-z]?$') THEN addr_tokens[1] ELSE list_filter(addr_tokens[1:4], lambda w: regexp_matches(w, '^\d+$'))[1] END AS house_number,
    list_filter(addr_tokens, lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^\d+$') AND NOT list_contains({_STOP}, w)) AS addr_distinctive,
    nullif(array_to_string(numeric_atoms[1:4], '_'), '') AS sorted_numeric_sig, coalesce(slash_compounds[1], house_tokens[1], numeric_atoms[1]) AS house_signature,
    {grams("addr_alnum", 3)} AS addr_c3, {grams("addr_alnum", 4)} AS addr_c4, {grams("addr_alnum", 5)} AS addr_c5 FROM a4)"""


def _ordered(a: str, b: str) -> str:
    return f"least({a}, {b}) || '_' || greatest({a}, {b})"


_TWO_NUMBERS = "list_filter(list_transform(numeric_atoms[1:2], lambda v: ltrim(v, '0')), lambda v: v <> '')"
_NO_SPACE = "array_to_string(name_tokens, '')"
_PAIRS = ", ".join(f"CASE WHEN len(distinctive) >= {j} THEN {_ordered(f'distinctive[{i}]', f'distinctive[{j}]')} END" for i in (1, 2, 3) for j in (2, 3, 4) if j > i)

#: Keys of each strategy over f (names and addresses), as SQL of a list; a null or empty key is none.
STRATEGIES: dict[str, str] = {
    "B01_exact_name": "[name_alnum]",
    "B02_no_legal_suffix": "[CASE WHEN name_no_suffix <> name_alnum THEN name_no_suffix END]",
    "B03_sorted_tokens": "[CASE WHEN name_tokens_sorted <> name_alnum THEN name_tokens_sorted END]",
    "B04_initials_pfx": "[CASE WHEN len(name_tokens) >= 2 THEN substr(name_initials, 1, 4) || '_' || substr(name_tokens[1], 1, 4) END]",
    "B05_first_two_tokens": "[name_tokens[1] || '_' || name_tokens[2]]",
    "B06_prefix4_len": "[CASE WHEN length(name_alnum) >= 4 THEN substr(name_alnum, 1, 4) || '_' || CAST(length(name_alnum) // 4 AS VARCHAR) END]",
    "B07_house_tok0": "[house_number || '_' || name_tokens[1]]",
    "B08_postal_name_pfx": "[CASE WHEN length(name_alnum) >= 3 THEN postal_code || '_' || substr(name_alnum, 1, 3) END]",
    "B09_postal_house": "[postal_code || '_' || house_number]",
    "B10_token_numeric": "[name_tokens[1] || '_' || numeric_atoms[1]]",
    "B11_addr_lead_tokens": "[addr_tokens[1] || '_' || addr_tokens[2]]",
    "B12_name_abbrev_expanded": "[CASE WHEN name_abbrev_expanded <> name_alnum THEN name_abbrev_expanded END]",
    "B13_name_no_space": f"[CASE WHEN length({_NO_SPACE}) >= 5 AND {_NO_SPACE} <> name_alnum THEN {_NO_SPACE} END]",
    "B14_first_distinctive_token": "[distinctive[1]]",
    "B15_prefix_suffix_4gram": "[CASE WHEN length(name_alnum) >= 8 THEN name_alnum[1:4] || '_' || name_alnum[-4:] END]",
    "B16_skip_gram": "[CASE WHEN length(name_alnum) >= 6 THEN name_alnum[1:2] || '_' || name_alnum[length(name_alnum) // 2 + 1:length(name_alnum) // 2 + 2] || '_' || name_alnum[-2:] END]",
    "B17_distinctive_tok_ngrams": "[CASE WHEN length(distinctive[1]) >= 5 THEN distinctive[1][1:3] || '_' || distinctive[1][-3:] END]",
    "B18_distinctive_token_pair": f"[{_PAIRS}]",
    "B19_first_last_distinctive": "[CASE WHEN len(distinctive) >= 2 THEN distinctive[1] || '_' || distinctive[-1] END]",
    "B20_tok1_house": "[distinctive[2] || '_' || house_number]",
    "B21_postal_distinctive_tok": "[postal_code || '_' || distinctive[1]]",
    "B22_street_name_joint": "[addr_distinctive[1] || '_' || distinctive[1]]",
    "B23_numeric_sig_name": "[CASE WHEN len(numeric_atoms) >= 2 THEN array_to_string(list_sort(numeric_atoms)[1:2], '_') || '_' || distinctive[1] END]",
    "B24_phonetic_tok0": "[phonetic[1][1:6]]",
    "B25_phonetic_pair": f"[CASE WHEN len(phonetic) >= 2 THEN {_ordered('phonetic[1][1:5]', 'phonetic[2][1:5]')} END]",
    "B26_soundex_postal": "[soundex_tokens[1] || '_' || postal_code]",
    "B27_phonetic_house": "[phonetic[1][1:5] || '_' || house_number]",
    "TB01_honorific_tok0": "[coalesce(honorific_distinctive[1], distinctive[1])]",
    "TB02_honorific_name": r"[coalesce(nullif(trim(regexp_replace(lower(name_no_honorific), '[^a-z0-9\s]', ' ', 'g')), ''), CASE WHEN name_no_honorific IS NULL THEN name_alnum END)]",
    "TB03_domain_concat": "[domain_clean, CASE WHEN length(replace(name_no_suffix, ' ', '')) >= 5 THEN replace(name_no_suffix, ' ', '') END, name_concat_distinctive]",
    "TB04_indic_translit_tok0": "[x0]",
    "TB05_indic_translit_postal": "[x0 || '_' || postal_code]",
    "TB06_postal_sorted_numeric": "[postal_code || '_' || sorted_numeric_sig]",
    "TB07_postal_slash_compound": "list_transform(slash_compounds, lambda v: postal_code || '_' || v)",
    "TB08_postal_house_token": "list_transform(house_tokens, lambda v: postal_code || '_' || v)",
    "TB09_addr_tok0_slash_compound": "list_transform(slash_compounds, lambda v: addr_distinctive[1] || '_' || v)",
    "TB10_addr_tok0_house_token": "list_transform(house_tokens, lambda v: addr_distinctive[1] || '_' || v)",
    "TB11_postal_addr_token_pair": f"[CASE WHEN len(addr_distinctive) >= 2 THEN postal_code || '_' || {_ordered('addr_distinctive[1]', 'addr_distinctive[2]')} END]",
    "TB12_translit_house_sig": "[x0 || '_' || house_signature]",
    "SB01_multiscript_translit_tok0": "CASE WHEN len(translit_distinctive) > 0 THEN [translit_distinctive[1], translit_phonetic[1]] ELSE [distinctive[1], phonetic[1]] END",
    "SB02_multiscript_translit_pair": f"[CASE WHEN len(translit_distinctive) >= 2 THEN {_ordered('translit_distinctive[1]', 'translit_distinctive[2]')} WHEN len(distinctive) >= 2 THEN {_ordered('distinctive[1]', 'distinctive[2]')} END]",
    "SB03_multiscript_translit_numeric": "[x0 || '_' || coalesce(house_signature, numeric_atoms[1])]",
    "SB04_lstrip_zeros_numeric_name": f"list_transform({_TWO_NUMBERS}, lambda v: x0 || '_' || v)",
    "SB05_pure_addr_postal_distinctive": "[country || '_' || postal_code || '_' || addr_distinctive[1]]",
    "SB06_pure_addr_distinctive_pair": f"[CASE WHEN len(addr_distinctive) >= 2 THEN country || '_' || {_ordered('addr_distinctive[1]', 'addr_distinctive[2]')} END]",
    "SB07_pure_addr_tok0_numeric": f"list_transform({_TWO_NUMBERS}, lambda v: addr_distinctive[1] || '_' || v)",
    "SB08_name_tok0_city_locality": "[x0 || '_' || addr_distinctive[1]]",
}

#: Fields: f has all derived fields of a record.
FIELDS = f"{NAMES},{ADDRESSES},\nf AS (SELECT nf.*, af.* EXCLUDE (entity_id), coalesce(translit_distinctive[1], distinctive[1]) AS x0 FROM nf JOIN af USING (entity_id))"


def keys(strategies: list[str] | None = None) -> str:
    """Common table expression keys (entity_id, source, country, strategy, key) of some or all strategies over f."""
    cells = ",\n    ".join(f"{{'strategy': '{k}', 'keys': {v}}}" for k, v in STRATEGIES.items() if strategies is None or k in strategies)
    return f"""listed AS (SELECT entity_id, source, country, unnest([{cells}]) AS x FROM f),
keys AS (SELECT DISTINCT entity_id, source, country, strategy, key FROM (SELECT entity_id, source, country, x.strategy AS strategy, unnest(x.keys) AS key FROM listed) WHERE key IS NOT NULL AND key <> '')"""


#: pairs (s1_id, cand_id, strategy), votes, and ranked (the first 40 of each s1_id).
PAIRS = """pairs AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id, a.strategy FROM keys a JOIN keys b USING (strategy, country, key) WHERE a.source = 'S1' AND b.source <> 'S1'),
votes AS (SELECT s1_id, cand_id, count(*) AS votes, list_sort(list(strategy)) AS strategies FROM pairs GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY votes DESC, cand_id) AS rank FROM votes) WHERE rank <= 40)"""


def ratio(a: str, b: str, kind: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    below = {"jaccard": f"(len({a}) + len({b}) - {both})", "cosine": f"sqrt(len({a}) * len({b}))", "containment": f"least(len({a}), len({b}))"}[kind]
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST({both} AS DOUBLE) / {below} END"


def _flag(condition: str) -> str:
    return f"CASE WHEN coalesce({condition}, FALSE) THEN 1.0 ELSE 0.0 END"


def _features() -> dict[str, str]:
    a, b = "l.{0}", "r.{0}"
    both = lambda x: (a.format(x), b.format(x))
    distinct = lambda x: tuple(f"list_distinct({v})" for v in both(x))
    alike = lambda x, kind: ratio(*distinct(x), kind)
    overlap = lambda x: f"CAST(len(list_intersect({', '.join(distinct(x))})) AS DOUBLE)"
    same = lambda x: _flag(f"l.{x} = r.{x} AND l.{x} <> ''")
    equal = lambda x, y="{}": _flag(f"{y.format(f'l.{x}')} = {y.format(f'r.{x}')}")
    bigrams = lambda x: f"(CASE WHEN length({x}) < 2 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))) END)"
    length = lambda x: f"CAST(abs(length(l.{x}) - length(r.{x})) AS DOUBLE)"
    shorter = lambda x: f"CAST(least(greatest(length(l.{x}), 1), greatest(length(r.{x}), 1)) AS DOUBLE) / greatest(length(l.{x}), length(r.{x}), 1)"
    numbers = tuple(f"list_distinct(list_filter(list_transform({v}, lambda d: ltrim(d, '0')), lambda d: d <> ''))" for v in both("numeric_atoms"))
    name, addr = alike("name_tokens", "jaccard"), alike("addr_tokens", "jaccard")
    exact, addr_exact = same("name_alnum"), same("addr_alnum")
    said = r"regexp_extract_all(l.name_raw, '\b\d+\b')"
    fired = {k: _flag(f"len(list_intersect(p.strategies, {_list(v)})) > 0") for k, v in V.FAMILIES.items()}
    return {
        "name_exact": exact, "name_no_suffix_exact": same("name_no_suffix"), "name_sorted_exact": equal("name_tokens_sorted"),
        "name_tok_jaccard": name, "name_tok_containment": alike("name_tokens", "containment"), "name_tok_overlap": overlap("name_tokens"),
        "name_c2_jaccard": ratio(bigrams("l.name_alnum"), bigrams("r.name_alnum"), "jaccard"), "name_c3_jaccard": alike("name_c3", "jaccard"), "name_c3_cosine": alike("name_c3", "cosine"),
        "name_c4_jaccard": alike("name_c4", "jaccard"), "name_c4_cosine": alike("name_c4", "cosine"), "name_len_diff": length("name_alnum"), "name_len_ratio": shorter("name_alnum"),
        "name_tok_diff": f"CAST(abs(len({distinct('name_tokens')[0]}) - len({distinct('name_tokens')[1]})) AS DOUBLE)", "name_distinctive_overlap": overlap("distinctive"), "initials_match": same("name_initials"),
        "phonetic_tok0_match": equal("phonetic[1]"), "phonetic_jaccard": alike("phonetic", "jaccard"),
        "legal_suffix_agree": "CASE WHEN len(l.legal_suffixes) = 0 AND len(r.legal_suffixes) = 0 THEN 0.5 WHEN len(l.legal_suffixes) > 0 AND l.legal_suffixes = r.legal_suffixes THEN 1.0 ELSE 0.0 END",
        "domain_name_contain": _flag("contains(r.name_alnum, l.name_tokens[1])"),
        "addr_exact": addr_exact, "addr_tok_jaccard": addr, "addr_tok_containment": alike("addr_tokens", "containment"), "addr_tok_overlap": overlap("addr_tokens"),
        "addr_c3_jaccard": alike("addr_c3", "jaccard"), "addr_c4_jaccard": alike("addr_c4", "jaccard"), "addr_len_diff": length("addr_alnum"), "addr_len_ratio": shorter("addr_alnum"),
        "addr_distinctive_overlap": overlap("addr_distinctive"), "numeric_atom_overlap": f"CAST(len(list_intersect({', '.join(numbers)})) AS DOUBLE)", "numeric_atom_jaccard": ratio(*numbers, "jaccard"),
        "house_num_exact": equal("house_number"), "house_num_norm_match": equal("house_number", "ltrim({}, '0')"), "postal_exact": equal("postal_code"),
        "postal_prefix2_match": equal("postal_code[1:2]"), "postal_prefix3_match": equal("postal_code[1:3]"), "postal_present_both": _flag("l.postal_code IS NOT NULL AND r.postal_code IS NOT NULL"),
        "postal_mismatch": _flag("l.postal_code <> r.postal_code"), "cand_addr_missing": _flag("r.addr_alnum = ''"),
        "name_x_addr": f"({name}) * ({addr})", "both_exact": f"({exact}) * ({addr_exact})", "both_strong": _flag(f"({name}) >= 0.6 AND ({addr}) >= 0.4"),
        "exact_name_partial_addr": _flag(f"({exact}) = 1 AND ({addr}) >= 0.25"), "partial_name_exact_addr": _flag(f"({name}) >= 0.5 AND ({addr_exact}) = 1"),
        "name_addr_numeric_consistent": _flag(f"len(list_intersect({said}, r.numeric_atoms)) > 0"), "source_is_s2": _flag("p.cand_id LIKE 'S2-%'"),
        "blocker_votes_count": "CAST(p.votes AS DOUBLE)", "cand_rank_by_votes": "CAST(p.rank AS DOUBLE)", "blocker_families_count": " + ".join(f"({v})" for v in fired.values()),
        **{f"fired_{k}_family": v for k, v in fired.items()},
    }


FEATURES = _features()
#: SELECT of s1_id, cand_id and all native features over ranked and f.
FEATURE_ROWS = "SELECT p.s1_id, p.cand_id, " + ", ".join(f"CAST(round_even(CAST({v} AS DOUBLE), 4) AS DOUBLE) AS {k}" for k, v in FEATURES.items()) + " FROM ranked p JOIN f l ON l.entity_id = p.s1_id JOIN f r ON r.entity_id = p.cand_id"
