"""SQL text of the splitting, packing and folding functions, as DuckDB reads it, for the registered queries' equivalents.

Every function takes SQL expressions and gives one. Look-behind is not to be had, so breaks are marked first, and marks
that an abbreviation forbids are taken out again. Folds are list_reduce over structs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from timedtext.functions import splitting as sp

#: Marks before and behind the white space of a break.
OPEN, SHUT = "\x01", "\x02"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(value: str, body: Callable[[str], str], name: str) -> str:
    """The body with the value computed once."""
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '\s+'), lambda w: w <> '')"


def nonempty(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: trim(p)), lambda p: p <> '')"


def _pieces(marked: str) -> str:
    return nonempty(rf"regexp_split_to_array({marked}, '{OPEN}\s+{SHUT}')")


def _unmark(text: str, before: str) -> str:
    return rf"regexp_replace({text}, '({before}){OPEN}(\s+){SHUT}', '\1\2', 'g')"


def split_sentences_simple(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.?!])(\s+)', '\1{OPEN}\2{SHUT}', 'g')"
    marked = _unmark(_unmark(marked, r"[\p{L}\p{N}_]\.[\p{L}\p{N}_]."), r"[A-Z][a-z]\.")
    return let(_pieces(marked), lambda v: f"case when len({v}) > 0 then {v} else [{text}] end", "simple")


def split_sentences_abbrev(text: str, lang: str) -> str:
    dotted = [w for w in (sp.GERMAN_ABBREVIATIONS if lang == "de" else sp.ENGLISH_ABBREVIATIONS) if w.endswith(".")]
    every = "|".join(re.escape(w).replace("\\-", "-") for w in sorted(dotted, key=lambda w: (-len(w), w)))
    marked = rf"regexp_replace(trim({text}), '([.!?])(\s+)([{sp.CAPITALS[lang]}])', '\1{OPEN}\2{SHUT}\3', 'g')"
    for _ in range(2):  # of two neighbouring abbreviations the second is met in the second pass
        marked = _unmark(marked, rf"(?:^|[^\p{{L}}\p{{N}}])(?:{every})")
    return _pieces(marked)


def fold(rows: str, start: dict[str, str], item_type: str, step: dict[str, str], item: str) -> str:
    """List of an item for each row: step and item read the state as a.field and the row as x.r; types follow start."""
    none = f"[]::{item_type}[]"
    zero = ", ".join(f"'{k}': {v}" for k, v in start.items())
    each = f"list_transform({rows}, lambda r: {{'r': r, 'out': {none}, {zero}}})"
    moved = ", ".join(f"'{k}': {step[k]}" for k in start)
    first = f"{{'r': list_extract({rows}, 1), 'out': {none}, {zero}}}"
    return f"(list_reduce({each}, lambda a, x: {{'r': x.r, 'out': a.out || [{item}], {moved}}}, {first})).out"


def pack(parts: str, joins: str, depth: str = "") -> str:
    """Greedy packing of parts; joins reads the piece so far as {last} and the part as {s}, its place from 0 as {i}."""
    a, x = f"a{depth}", f"x{depth}"
    cond = joins.format(last=f"{a}.l[-1]", s=f"{x}.s", i=f"{x}.i")
    each = f"list_transform({parts}, lambda s{depth}, i{depth}: {{'l': []::varchar[], 's': s{depth}, 'i': (i{depth} - 1)::bigint}})"
    grown = f"case when len({a}.l) = 0 then [{x}.s] when {cond} then {a}.l[1:len({a}.l) - 1] || [{a}.l[-1] || ' ' || {x}.s] else {a}.l || [{x}.s] end"
    return f"(list_reduce({each}, lambda {a}, {x}: {{'l': {grown}, 's': '', 'i': 0::bigint}}, {{'l': []::varchar[], 's': '', 'i': 0::bigint}})).l"


def pack_words(text: str, limit: int, least: int) -> str:
    def packed(w: str) -> str:
        each = f"list_transform({w}, lambda pw, pi: {{'out': []::varchar[], 'now': '', 'rest': false, 'w': pw, 'i': (pi - 1)::bigint}})"
        fits = f"(b.rest or b.now = '' or length(b.now) + 1 + length(y.w) <= {limit})"
        rest = f"(b.rest or (not {fits} and len({w}) - y.i < {least}))"
        joins = f"({fits} or {rest})"
        out = f"case when {joins} then b.out else b.out || [b.now] end"
        now = f"case when not {joins} or b.now = '' then y.w else b.now || ' ' || y.w end"
        zero = "{'out': []::varchar[], 'now': '', 'rest': false, 'w': '', 'i': 0::bigint}"
        done = f"list_reduce({each}, lambda b, y: {{'out': {out}, 'now': {now}, 'rest': {rest}, 'w': '', 'i': 0::bigint}}, {zero})"
        return f"case when len({w}) <= {least} then [coalesce({text}, '')] else {let(done, lambda z: f'{z}.out || [{z}.now]', 'packed')} end"

    return let(words(text), packed, "ws")


def pack_sentences(sentences: str, limit: int, least: int) -> str:
    def packed(xs: str) -> str:
        rest = f"len({words(f"array_to_string({xs}[({{i}} + 1):], ' ')")})"
        return pack(xs, f"(length({{last}}) + 1 + length({{s}}) <= {limit} or {rest} < {least})")

    return let(sentences, packed, "sentences")


def split_text(text: str, limit: int, least: int, lang: str) -> str:
    def whole(t: str) -> str:
        fits = f"list_filter({pack(split_sentences_abbrev(t, lang), f'length({{last}}) + 1 + length({{s}}) <= {limit}')}, lambda p: p <> '')"
        pieces = f"flatten(list_transform({fits}, lambda p: case when length(p) <= {limit} then [p] else {pack_words('p', limit, least)} end))"
        return f"case when length({t}) <= {limit} then [{t}] else {pack(pieces, f'len({words("{s}")}) < {least}', '2')} end"

    return let(f"trim(coalesce({text}, ''))", whole, "whole")


def split_capped(text: str, limit: int) -> str:
    both = lambda xs: f"case when len({xs}) = 1 then {pack_words(text, limit, 3)} else {pack_sentences(xs, limit, 3)} end"
    return f"case when length({text}) <= {limit} or len({words(text)}) < 3 then [{text}] else {let(split_sentences_simple(text), both, 'found')} end"


def split_clauses(text: str, most: int, least: int) -> str:
    tokens = lambda t: f"ceil(length({t}) / 4)"
    clauses = nonempty(rf"string_split(regexp_replace(coalesce({text}, ''), '([.;,])\s+', '\1{OPEN}', 'g'), '{OPEN}')")
    packed = pack(clauses, tokens("({last} || ' ' || {s})") + f" <= {most}")
    return f"case when {tokens(text)} <= {most} then [{text}] else {pack(packed, tokens('{s}') + f' < {least}', '2')} end"


def collapse_repeats(text: str) -> str:
    def drop(ws: str, n: int) -> str:
        each = f"list_transform({ws}, lambda w: {{'l': []::varchar[], 'w': w}})"
        grown = "(a.l || [x.w])"
        same = f"len({grown}) >= {2 * n} and {grown}[-{n}:] = {grown}[-{2 * n}:-{n + 1}]"
        step = f"case when {same} then {grown}[:len({grown}) - {n}] else {grown} end"
        return f"(list_reduce({each}, lambda a, x: {{'l': {step}, 'w': ''}}, {{'l': []::varchar[], 'w': ''}})).l"

    dropped = lambda ws: f"array_to_string(case when len({ws}) > 4 then {drop(drop(ws, 3), 2)} else {ws} end, ' ')"
    return let(words(text), dropped, "ws")


def joined(keys: str) -> str:
    """Rows of each group as one, as the joins of neighbouring segments make them; reads media_id, seq, start_sec, end_sec, text."""
    order = "order by start_sec, seq"
    text = f"coalesce(string_agg(nullif(trim(coalesce(text, '')), ''), ' ' {order}), '') as text"
    return f"media_id, first(seq {order}) as seq, first(start_sec {order}) as start_sec, last(end_sec {order}) as end_sec, {text}, count(*) as n_rows, {keys}"


ORDER = "(partition by media_id order by start_sec, seq)"
SO_FAR = "(partition by media_id order by start_sec, seq rows unbounded preceding)"


def count_words(text: str) -> str:
    return f"len({words(text)})"


def force_merged(source: str, least_dur: float, least_words: int, name: str) -> str:
    """Common table expressions, the last called name: short segments of source joined to the ones before."""
    long = lambda begin, n: f"round(end_sec - {begin}, 3) >= {least_dur} and {n} >= {least_words}"
    return f"""{name}_r as (select *, row_number() over {ORDER} as rn, {count_words("text")} as wc, first_value(start_sec) over {SO_FAR} as began from {source}),
{name}_h as (select *, {long("began", f"sum(wc) over {SO_FAR}")} as head, not coalesce(start_sec <= end_sec, false) or ({long("start_sec", "wc")}) as opens from {name}_r),
{name}_e as (select *, min(case when head then rn end) over (partition by media_id) as head_end from {name}_h),
{name}_p as (select *, sum(case when rn = 1 or (rn > head_end and opens) then 1 else 0 end) over {SO_FAR} as part from {name}_e),
{name} as (select * exclude (n_rows, part) from (select {joined("part")} from {name}_p group by media_id, part))"""


def timed(source: str, pieces: str, name: str, exact_end: bool = True, kept: str = "media_id, seq", begin: str = "start_sec", end: str = "end_sec") -> str:
    """Common table expressions, the last called name: a row per piece with its share of the segment's time by characters."""
    share = lambda chars, k: f"{begin} + ({end} - {begin}) * case when total > 0 then ({chars})::double / total else ({k})::double / n end"
    last = f"case when piece + 1 = n then {end} else {share('upto', 'piece + 1')} end" if exact_end else share("upto", "piece + 1")
    return f"""{name}_l as (select *, {pieces} as pieces from {source}),
{name}_x as (select * exclude (pieces), len(pieces) as n, unnest(pieces) as said, unnest(range(len(pieces)))::int as piece from {name}_l),
{name}_s as (select *, sum(length(said)) over (partition by media_id, seq order by piece rows unbounded preceding) as upto, sum(length(said)) over (partition by media_id, seq) as total from {name}_x),
{name} as (select {kept}, piece, {share("upto - length(said)", "piece")} as start_sec, {last} as end_sec, said as text from {name}_s)"""


def renumbered(source: str, name: str, rest: str = "") -> str:
    columns = f"media_id, (row_number() over (partition by media_id order by seq, piece) - 1)::int as seq, start_sec, end_sec, text{rest}"
    return f"{name} as (select {columns} from {source})"


def parted(source: str, start: dict[str, str], step: dict[str, str], name: str, fields: str = "") -> str:
    """Common table expressions, the last called name: source with part, the state's field k after each row of a medium in order."""
    row = f"{{'seq': seq, 'start_sec': start_sec, 'end_sec': end_sec, 'text': text{fields}}}"
    return f"""{name}_l as (select media_id, list({row} order by start_sec, seq) as rows from {source} group by media_id),
{name}_k as (select media_id, rows, {fold("rows", start, "bigint", step, step["k"])} as parts from {name}_l),
{name} as (select media_id, r.seq, r.start_sec, r.end_sec, r.text, part from (select media_id, unnest(rows) as r, unnest(parts) as part from {name}_k))"""


def gap_merged(source: str, gap: float, most_dur: float, most_chars: int, name: str) -> str:
    """Common table expressions, the last called name: neighbours joined by gap, length and characters."""
    n = "length(trim(coalesce(x.r.text, '')))"
    longer = f"(a.chars + {n} + case when a.chars > 0 and {n} > 0 then 1 else 0 end)"
    joins = f"coalesce(a.k >= 0 and x.r.start_sec - a.fin between 0 and {gap} and x.r.end_sec - a.beg <= {most_dur} and {longer} <= {most_chars}, false)"
    start = {"k": "-1::bigint", "beg": "0.0::double", "fin": "0.0::double", "chars": "0::bigint"}
    step = {"k": f"case when {joins} then a.k else a.k + 1 end", "beg": f"case when {joins} then a.beg else x.r.start_sec end", "fin": "x.r.end_sec"}
    step["chars"] = f"(case when {joins} then {longer} else {n} end)::bigint"
    merged = f"select {joined('part')} from {name}_p group by media_id, part"
    return f"{parted(source, start, step, f'{name}_p')},\n{name} as (select * exclude (part) from ({merged}) where text <> '')"


def tempo(factor: str) -> str:
    """The chain of tempo filters; halves of the sixth place, of the number as it is written, are rounded up."""
    shown = lambda x: f"'atempo=' || ({x})::varchar::decimal(38, 20)::decimal(18, 6)::varchar"
    up = f"greatest(ceil(log2({factor}) - 1e-12) - 1, 0)::int"
    down = f"greatest(ceil(-log2({factor}) - 1e-12) - 1, 0)::int"
    rest = f"(({factor}) / pow(2.0::double, {up}) * pow(2.0::double, {down}))"
    last = f"case when abs({rest} - 1) > 0.001 then [{shown(rest)}] else [] end"
    chain = f"list_transform(range({down}), lambda i: 'atempo=0.5') || list_transform(range({up}), lambda i: 'atempo=2.0') || {last}"
    return f"case when ({factor}) is null or ({factor}) <= 0 then 'atempo=1.0' when ({factor}) between 0.5 and 2.0 then {shown(factor)} else array_to_string({chain}, ',') end"


def pattern_entities(text: str) -> str:
    """JSON of the places of handle-like tokens, without those inside a longer one."""
    def places(pattern: str) -> str:
        found, between = f"regexp_extract_all({text}, '{pattern}')", f"regexp_split_to_array({text}, '{pattern}')"
        upto = f"coalesce(list_sum(list_transform({between}[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda v: length(v))), 0)"
        return f"list_transform({found}, lambda m, i: {{'a': ({upto})::bigint, 'b': ({upto} + length(m))::bigint, 't': m}})"

    def outer(both: str) -> str:
        inside = f"len(list_filter({both}, lambda o: o.a <= s.a and o.b >= s.b and (o.a < s.a or o.b > s.b))) > 0"
        kept = f"list_filter({both}, lambda s: not ({inside}))"
        shown = """'{"start":' || k.a || ',"end":' || k.b || ',"text":"' || k.t || '"}'"""
        return f"'[' || array_to_string(list_transform({kept}, lambda k: {shown}), ',') || ']'"

    found = f"list_sort(list_distinct({places(r'\b[A-Za-z0-9_]+K[0-9]+\b')} || {places(r'\b[A-Za-z]+[0-9]{1,3}\b')}))"
    return let(found, outer, "spans")
