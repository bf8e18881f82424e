"""The address parser in DuckDB's SQL: components as rows, roles by CASE, answers as aggregates. It shares the fixed tables and patterns with the DataFrame code and nothing else."""

from __future__ import annotations

from kinloom.operators import addresses as a


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _map(table: dict[tuple[str, str], str]) -> str:
    return "MAP {" + ", ".join(f"{_quoted(country + '|' + name)}: {_quoted(value)}" for (country, name), value in table.items()) + "}"


def _words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def _join(items: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({items}, {_quoted(by)}), '')"


def _expanded(items: str) -> str:
    bare = "regexp_replace(w, '^([0-9]+)(st|nd|rd|th)$', '\\1')"
    return f"list_transform({items}, lambda w: coalesce(map_extract(streets, land || '|' || {bare})[1], {bare}))"


def _without_zeros(text: str) -> str:
    return f"regexp_replace({text}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"


def _place(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, {_quoted(a.PLACE_BEFORE)}, ''), {_quoted(a.PLACE_AFTER)}, ''))"


def parse_sql(rows: str) -> str:
    """SQL for the parsed columns of a query of rows (id, addr, country)."""
    code = " ".join(f"WHEN {_quoted(country)} THEN {_quoted('^(' + pattern + ')$')}" for country, pattern in a.POSTCODES.items())
    code = f"CASE land {code} ELSE {_quoted('^(' + a.OTHER_POSTCODE + ')$')} END"
    clean = "regexp_replace(p, '[^\\p{L}\\p{M}\\p{N}/#°-]', ' ', 'g')"
    part = _join(f"list_filter(string_split({clean}, ' '), lambda w: w <> '' AND w <> 'null')")
    key = _join(_words("regexp_replace(part, '[#°/-]', ' ', 'g')"))
    return f"""
SELECT * FROM (
WITH tables AS (SELECT {_map(a.state_names())} AS states, {_map(a.street_names())} AS streets),
input AS ({rows}),
cut AS (
  SELECT id, country, coalesce(country, '') AS land, list_filter(list_transform(string_split(strip_accents(lower(coalesce(addr, ''))), ','), lambda p: {part}), lambda p: p <> '') AS parts
  FROM input
),
one AS (SELECT id, land, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM cut),
keyed AS (SELECT *, {key} AS key, {_words("regexp_replace(part, '[#°/-]', ' ', 'g')")} AS words, {code} AS code FROM one),
coded AS (
  SELECT k.*, states, streets, regexp_matches(key, code) AS is_code, list_filter(words, lambda w: regexp_matches(w, code)) AS codes, list_filter(words, lambda w: NOT regexp_matches(w, code)) AS others,
    map_extract(states, land || '|' || key)[1] AS own_state
  FROM keyed k, tables
),
told AS (SELECT *, {_join('others')} AS rest, map_extract(states, land || '|' || {_join('others')})[1] AS rest_state FROM coded),
wide AS (SELECT *, {_expanded('words')} AS all_wide, {_expanded('others')} AS rest_wide FROM told),
roles AS (
  SELECT *, CASE
    WHEN own_state IS NOT NULL THEN CASE WHEN length(key) <= 3 THEN 'code' ELSE 'name' END
    WHEN is_code THEN 'postcode'
    WHEN len(codes) > 0 AND len(others) > 0 AND len(words) <= 4 AND rest_state IS NOT NULL THEN 'state beside'
    WHEN len(codes) > 0 AND len(others) BETWEEN 1 AND 3 AND len(words) <= 4 AND NOT regexp_matches(rest, '[0-9]') AND NOT list_has_any(rest_wide, {_list(a.STREET_WORDS)}) THEN 'place beside'
    WHEN regexp_matches(key, '[0-9]') OR list_has_any(all_wide, {_list(a.STREET_WORDS)}) OR list_has_any(words, {_list(a.LANDMARKS)}) THEN 'street'
    ELSE 'place' END AS role
  FROM wide
),
states AS (
  SELECT id, coalesce(min(i) FILTER (role = 'state beside'), min(i) FILTER (role = 'code'), min(i) FILTER (role = 'name')) AS state_at, min(i) FILTER (role = 'name') AS name_at,
    arg_max(CASE WHEN role = 'postcode' THEN key ELSE codes[1] END, i) FILTER (role IN ('postcode', 'state beside', 'place beside')) AS postcode
  FROM roles GROUP BY id
),
chosen AS (SELECT s.*, r.role AS state_role, CASE WHEN r.role = 'state beside' THEN r.rest_state ELSE r.own_state END AS state FROM states s LEFT JOIN roles r ON s.id = r.id AND s.state_at = r.i),
places AS (
  SELECT r.id, {_place("CASE WHEN r.role = 'place beside' THEN r.rest ELSE r.key END")} AS place, CASE WHEN c.state_role = 'code' AND c.name_at < c.state_at AND r.i = c.name_at THEN c.state_at ELSE r.i END AS spot
  FROM roles r JOIN chosen c ON r.id = c.id
  WHERE r.role IN ('place', 'place beside') OR (r.role IN ('code', 'name') AND r.i <> c.state_at AND NOT (c.state_role = 'state beside' AND r.i < c.state_at))
),
towns AS (SELECT id, list(place ORDER BY spot, place) AS found FROM (SELECT id, place, min(spot) AS spot FROM places WHERE place <> '' GROUP BY id, place) GROUP BY id),
units AS (SELECT id, arg_min(unit, i) AS unit FROM (SELECT id, i, land, regexp_extract(part, {_quoted(a.UNIT_VALUE)}, 2) AS unit FROM roles WHERE role = 'street') WHERE unit <> '' AND land <> 'France' GROUP BY id),
rests AS (SELECT *, regexp_replace(part, {_quoted(a.HOUSE_MARK)}, '') AS bare FROM roles WHERE role = 'street' AND (land = 'India' OR NOT regexp_matches(part, {_quoted(a.UNIT_START)}))),
marked AS (SELECT *, regexp_extract(bare, {_quoted(a.HOUSE)}, 2) AS token, regexp_extract(bare, {_quoted(a.HOUSE)}, 1) AS ahead, regexp_replace(bare, {_quoted(a.HOUSE)}, '') AS after FROM rests),
houses AS (SELECT id, min(i) AS house_at, regexp_replace(arg_min(token, i), '^[/-]+|[/-]+$', '', 'g') AS token, arg_min(after, i) AS after FROM marked WHERE token <> '' GROUP BY id),
texts AS (SELECT m.id, string_agg(CASE WHEN m.i = h.house_at THEN m.ahead || ' ' || m.after ELSE m.bare END, ' ' ORDER BY m.i) AS text, any_value(m.land) AS land, any_value(m.streets) AS streets FROM marked m LEFT JOIN houses h ON m.id = h.id GROUP BY m.id),
roads AS (SELECT id, list_filter({_expanded(_words("regexp_replace(text, '[#°/-]', ' ', 'g')"))}, lambda w: NOT list_contains({_list([*a.LANDMARKS, 'bis', 'ter'])}, w)) AS road FROM texts),
numbers AS (
  SELECT id, string_agg(d, ' ' ORDER BY length(d), d) AS numbers FROM (SELECT DISTINCT id, regexp_replace(unnest(regexp_extract_all({_join('parts')}, '[0-9]+')), '^0+([0-9])', '\\1') AS d FROM cut) GROUP BY id
)
SELECT c.id, coalesce(ch.state, '') AS state, {_join('found', '|')} AS places, coalesce(found[-1], '') AS city, coalesce(ch.postcode, '') AS postcode,
  coalesce({_without_zeros('h.token')}, '') AS house, coalesce(regexp_replace(regexp_extract(h.token, '[0-9]+'), '^0+([0-9])', '\\1'), '') AS house_digits,
  coalesce(CASE WHEN regexp_extract(h.token, '[0-9]([a-z]+)$', 1) <> '' THEN regexp_extract(h.token, '[0-9]([a-z]+)$', 1) ELSE regexp_extract(h.after, '^ *(bis|ter)\\b', 1) END, '') AS house_suffix,
  coalesce({_without_zeros('u.unit')}, '') AS unit, {_join('road')} AS street, coalesce(n.numbers, '') AS numbers,
  {_join("list_sort(list_distinct(list_concat(coalesce(road, []), " + _words("coalesce(array_to_string(found, ' '), '')") + ", CASE WHEN ch.state IS NULL THEN [] ELSE [ch.state] END)))")} AS words,
  len(c.parts) = 0 AS is_empty, len(c.parts)::INTEGER AS components, list_has_any({_words(_join('c.parts'))}, {_list(a.LANDMARKS)}) AS landmark
FROM cut c LEFT JOIN chosen ch ON c.id = ch.id LEFT JOIN towns t ON c.id = t.id LEFT JOIN houses h ON c.id = h.id LEFT JOIN units u ON c.id = u.id LEFT JOIN roads r ON c.id = r.id LEFT JOIN numbers n ON c.id = n.id
)"""
