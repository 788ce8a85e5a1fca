"""The same results in DuckDB's SQL, where it can express them."""

from __future__ import annotations

from .filter_audit import DISTINCT_SHARE, FILTERS, METRICS, SYMBOLS, UPPER_SHARE
from .filter_audit import MIN_WORDS as FEW_WORDS
from .hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES
from .quality import CHAR_LIMIT, CLASSES, COMMON_WORDS, MIN_WORDS, WINDOW, WORD_LIMIT


def quality() -> str:
    counts = []
    for pattern in CLASSES.values():
        inner = pattern[1:-1] if pattern.startswith("[") else pattern
        counts.append("length(regexp_replace(t, '[^" + inner.replace("'", "''") + "]+', '', 'g'))")
    words = " ".join(f"when '{lang}' then [" + ", ".join(f"len(list_filter(l, lambda x: x = '{w}'))" for w in own) + "]" for lang, own in COMMON_WORDS.items())
    known = ", ".join(f"'{lang}'" for lang in COMMON_WORDS)
    return rf"""
with d as (select doc_id, case when lang in ({known}) then lang else '' end as lang, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
n as (select *, len(w) as n_words, list_transform(w, lambda x: lower(x)) as l from w),
win as (select doc_id, i, list_slice(w, i, i + {WINDOW - 1}) as g from (select doc_id, w, unnest(range(1, n_words - {WINDOW - 2})) as i from n where n_words >= {WINDOW})),
dup as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 1),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from dup, range(0, {WINDOW}) r(k) group by 1),
c as (select doc_id, lang, n_words, length(t) as total, [{", ".join(counts)}] as c, case lang {words} else [] end as f from n),
h as (select doc_id, lang, 'c' as kind, unnest(list_append(c, total - list_sum(c))) as v, generate_subscripts(list_append(c, total - list_sum(c)), 1) as k from c
  union all select doc_id, lang, 'w', unnest(list_append(f, n_words - list_sum(f))), generate_subscripts(list_append(f, 0), 1) from c where lang <> ''),
p as (select doc_id, kind, v / nullif(sum(v) over (partition by doc_id, kind), 0)::double as p, sum(v) over (partition by lang, kind, k) / nullif(sum(v) over (partition by lang, kind), 0)::double as q from h),
j as (select doc_id, kind, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as js from p where p is not null group by 1, 2),
b as (select n.doc_id, n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from n left join rep using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select f.doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and (n_words < {MIN_WORDS} or (coalesce(x.js, 0) <= {CHAR_LIMIT} and coalesce(y.js, 0) <= {WORD_LIMIT})) as kept
from f left join j x on x.doc_id = f.doc_id and x.kind = 'c' left join j y on y.doc_id = f.doc_id and y.kind = 'w'
"""


def filter_audit() -> str:
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    sums = ", ".join(f"sum({m})::bigint as {m}" for m in METRICS[:-1])
    return rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as least from d),
g as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
m as (select part, case when len(w) < {FEW_WORDS} then 1 else 0 end + case when 100 * len(list_distinct(w)) < {DISTINCT_SHARE} * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {UPPER_SHARE} * length(t) then 4 else 0 end + case when regexp_matches(t, '{SYMBOLS}') then 8 else 0 end
    + case when doc_id > least then 16 else 0 end as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w left join g using (doc_id)),
c as (select part, mask, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from m group by 1, 2),
f as (select * from (values {letters}) as f(letter, bit)),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a, b, c, d, e] as fs from f a, f b, f c, f d, f e
  where a.bit | b.bit | c.bit | d.bit | e.bit = {(1 << len(FILTERS)) - 1}),
s as (select filter_order, unnest(fs) as f, generate_subscripts(fs, 1) as step from o),
x as (select part, filter_order, step::integer as step, f.letter as letter, f.bit as bit, mask, n, n_good, n_toxic,
    coalesce(bit_or(mask & f.bit) over (partition by part, mask, filter_order order by step rows between unbounded preceding and 1 preceding), 0) as earlier from c, s),
y as (select part, filter_order, step, letter, case when mask & bit = 0 and earlier = 0 then n else 0 end as kept, case when mask & bit <> 0 and earlier = 0 then n else 0 end as removed,
    case when mask & bit <> 0 and earlier <> 0 then n else 0 end as redundant, case when mask = bit then n else 0 end as unique_fails,
    case when mask & bit <> 0 and earlier = 0 then n_good else 0 end as good_lost, case when mask & bit <> 0 and earlier = 0 then n_toxic else 0 end as toxic_lost from x),
z as (select part, filter_order, step, letter, {sums} from y group by 1, 2, 3, 4)
select part, filter_order, step, {", ".join(METRICS[:-1])}, (sum(removed) over (partition by part, letter))::bigint as shapley from z
"""


def hard_negatives() -> str:
    return f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {POSITIVES})
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::integer as rank, other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= {NEGATIVES}
"""
