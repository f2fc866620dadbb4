"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
import pathlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import (
    binary_ann, chat, conversation_repair, exact_topk, language, line_templates, merge_encoding, minhash_dedup, mixing, rule_quality, secret_scan, toxicity,
    vector_codes,
)
from weftline.llm.text_features import fold

#: Where the public tokenizer files lie; None asks the installed package ``public_tokenizers``.
TOKENIZERS: str | None = None
PIECES = "piece_bpe_32k.model"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(folder: str | None = TOKENIZERS) -> bytes:
    """The model file, read once on the driver; tasks get its bytes."""
    if folder is None:
        import public_tokenizers

        return pathlib.Path(public_tokenizers.path(PIECES)).read_bytes()
    return pathlib.Path(folder, PIECES).read_bytes()


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[fn.__name__] = fn
    return fn


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.topk_inner_product(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


SQL["op9_exact_topk"] = """
with rows as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from rows q join rows c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, place::integer as "rank", vec_id, score from placed where place <= 5
"""


@query
def op10_binary_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)


@query
def op8_merge_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = merge_encoding.encode(docs, "text", model, decoded="decoded")
    return done.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), merge_encoding.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, "doc_id", "text", "lang", fold(F.col("doc_id"), 4) != 2)
    found = language.predict(docs.drop("lang"), "text", model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", fold(F.col("doc_id"), 5) != 0)
    found = toxicity.score(docs, "text", model)
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op3_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = rule_quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", fold(F.col("doc_id"), 4) != 2)
    found = rule_quality.score(docs, "text", ensemble)
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op2_pareto_mix"] = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u
    from documents
), weighed as (select *, length(bin(size))::double as w from sized
), sources as (
    select source, sum(size)::double as s, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as share
    from weighed group by source
), filled as (
    select *, (sum(s) over () - coalesce(sum(3 * s) over (order by 3 * s / share, source rows between unbounded preceding and 1 preceding), 0))
        / sum(share) over (order by 3 * s / share, source rows between current row and unbounded following) as level
    from sources
), levelled as (select *, min_by(level, 3 * s / share) filter (where level * share <= 3 * s) over () as fits from filled
), goals as (select source, s, case when fits is null then 3 * s else least(3 * s, fits * share) end as target from levelled
), classes as (
    select source, w, sum(size)::double as mass from weighed group by all
), shared as (
    select c.*, g.s, g.target, (g.target - 3 * coalesce(sum(mass) over (partition by c.source order by w desc rows between unbounded preceding and 1 preceding), 0))
        / nullif(sum(w * mass) over (partition by c.source order by w desc rows between current row and unbounded following), 0) as f
    from classes c join goals g on c.source is not distinct from g.source
), factors as (select *, max_by(f, w) filter (where f * w <= 3) over (partition by source) as factor from shared
), copies as (select source, w, mass, s, target, coalesce(least(3.0, factor * w), 3.0) as e from factors
), rests as (select source, max(target) - sum(floor(e) * mass) as rest from copies group by source
), ranked as (
    select d.doc_id, d.source, d.size, c.s, c.target, floor(c.e) as whole, r.rest,
        case when c.e > floor(c.e) then (u / (1 - u)) / ((c.e - floor(c.e)) / (1 - (c.e - floor(c.e)))) end as q
    from weighed d join copies c on d.source is not distinct from c.source and d.w = c.w join rests r on d.source is not distinct from r.source
), drawn as (
    select *, case when q is not null then coalesce(sum(case when q is not null then size end)
        over (partition by source order by q nulls last, doc_id rows between unbounded preceding and 1 preceding), 0) end as before_it from ranked
)
select doc_id, size, s::bigint as source_size, target, ((whole + case when before_it + size / 2.0 <= rest then 1 else 0 end) * size)::bigint as taken from drawn
"""


@query
def op4_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    read = chat.read_back(chat.examples(given.unionByName(probe), "conv_id", "turn", "role", "text"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


SQL["op4_chat_prefixes"] = r"""
with given as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
    select *, length('<|' || regexp_replace(role, '([\\|<\[])', '\\\1', 'g') || '|>' || chr(10)) + length('</s>' || chr(10))
        + length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) as chars,
        row_number() over (partition by conv_id order by turn, role, text) as place, count(*) over (partition by conv_id) as n
    from given
), summed as (select *, sum(chars) over (partition by conv_id order by place) as upto from marked)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
    coalesce(sum(upto) filter (where role = 'assistant' or place = n), 0)::bigint as formatted_chars
from summed group by conv_id
"""


@query
def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


SQL["op5_line_templates"] = r"""
with recursive docs as (
    select distinct doc_id, regexp_replace(text, '[\x20\x09\x0B-\x0D]+', ' ', 'g') as text, md5(coalesce(doc_id::varchar, '') || '/' || text) as doc
    from documents where text is not null
), cut as (select doc, string_split(text, chr(10)) as parts from docs
), numbered as (select doc, parts[i] as line, i - 1 as pos from (select *, unnest(range(1, len(parts) + 1)) as i from cut)
), squeezed as (select doc, pos, trim(line, ' ') as line from numbered
), masked as (
    select *, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') as fields, len(string_split(line, ' ')) as size from squeezed where line <> ''
), lines as materialized (
    select doc, pos, size, case when size - len(regexp_extract_all(line, '[^ ]*[0-9][^ ]*')) >= size * 0.5 then fields else line end as template from masked
), parsed as materialized (
    select *, string_split(template, ' ') as tokens, case when size > 4 then concat_ws(' ', size::varchar, array_to_string(string_split(template, ' ')[1:3], ' ')) end as leaf,
        greatest(3, least(10, ceil(100.0 / size))) as needed from lines
), units as materialized (
    select distinct doc, unnest(regexp_split_to_array(replace(text, chr(10), 'x '), '[bdfhjlnprtvxz.,;:!?] ')) as s from docs where doc in (select doc from parsed)
), sizes as (select doc, count(*) as n from units group by doc
), links as materialized (
    select a.doc as a, b.doc as b from units a join units b on a.s = b.s and a.doc <> b.doc join sizes x on x.doc = a.doc join sizes y on y.doc = b.doc
    group by a.doc, b.doc having count(*) >= 0.5 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(doc, other) as (select doc, doc from sizes union select r.doc, l.b from reach r join links l on l.a = r.other
), families as materialized (select doc, min(other) as family from reach group by doc
), rows as materialized (select p.*, family from parsed p join families using (doc)
), direct as materialized (select template from rows group by template, needed having count(distinct family) >= needed
), rest as (select * from rows where leaf is not null and template not in (from direct)
), leaves as (select leaf from rest group by leaf having count(distinct family) >= 10
), kinds as materialized (select leaf, template, any_value(size) as size, any_value(tokens) as tokens, list(distinct family) as families from rest where leaf in (from leaves) group by leaf, template
), spread as (select leaf, template, size, families, unnest(tokens) as token, unnest(range(len(tokens))) as place from kinds
), frequent as (select leaf, place, token from spread where token <> '<*>' group by all having sum(len(families)) >= 10
), held as materialized (
    select leaf, template, any_value(size) as size, any_value(families) as families, list({'place': place, 'token': token} order by place) as held,
        count(*) filter (where place >= 3) as behind from spread join frequent using (leaf, place, token) group by leaf, template
), formed as (select * from held where len(held) >= size * 0.6 and behind >= (size - 3) / 2
), loose as (select leaf, held as needed from (select leaf, held, unnest(families) as family from formed) group by leaf, held having count(distinct family) >= 10
), gone as materialized (
    select template from direct union select f.template from formed f join loose l on l.leaf = f.leaf and len(list_filter(l.needed, lambda x: not list_contains(f.held, x))) = 0
), lost as (select doc, list(distinct pos) as positions from parsed where template in (from gone) group by doc
)
select d.doc_id, coalesce(len(positions), 0)::bigint as n_dropped,
    case when positions is null then d.text else array_to_string([p for p, i in string_split(d.text, chr(10)) if not list_contains(positions, i - 1)], chr(10)) end as text
from documents d left join lost l on l.doc = md5(coalesce(d.doc_id::varchar, '') || '/' || d.text)
"""


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL["op1_minhash"] = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), cut as (
    select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from (select *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from cut group by 1
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as common from cut a join cut b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
), reach(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select r.doc_id, l.b from reach r join links l on l.a = r.other
), least_ as (select doc_id, min(other) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least_ using (doc_id) left join sizes using (doc_id)
"""


#: What damages a row, by the remainder of its key's crc32.
DROP, EMPTY, CUT, TWICE, AS_USER = range(5)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == EMPTY, F.lit("")).when(fault == CUT, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = given.select(
        "conv_id", "turn", F.when(fault == AS_USER, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), (fault != DROP).alias("present"),
        F.explode(F.when(fault == TWICE, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    found = conversation_repair.repair(rows, "conv_id", "turn", "role", "text", F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


def _dearer(paths: str, cost: str, edit: str) -> str:
    """SQL: a path (nine digits of cost, then the audit) with one more edit."""
    return f"(lpad((substr({paths}, 1, 9)::integer + {cost})::varchar, 9, '0') || substr({paths}, 10) || '{edit}')"


SQL["op11_conversation_repair"] = r"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k,
        dense_rank() over (order by conv_id nulls first) as g
    from conversations
), folded as (
    select *, xor(list_reduce(
        flatten(list_transform(range(1, length(k) + 1), lambda i: [ord(substr(k, i::integer, 1))::bigint, 0, 0, 0, 0, 0, 0, 0])),
        lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::bigint), 4294967295::bigint) % 20 as fault
    from keyed
), damaged as (
    select g, turn, case when fault = 4 then 'user' else role end as role,
        case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when fault = 3 then [1, 2] else [1] end) as copy
    from folded where fault <> 0
), placed as (
    select *, row_number() over (partition by g order by turn nulls first, role, text) as i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said, substr(role, 1, 1) as letter
    from damaged
), repeated as (
    select *, row_number() over (partition by g, role, text order by i) > 1 as again, lead(letter) over (partition by g order by i) as following from placed
), faults as (
    select *, case when said = '' then 'blank' when again then 'duplicate' when right(said, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from repeated
), coded as (select *, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then 5 else 0 end as extra from faults
), sizes as (select g, conv_id, coalesce(n, 0) as n from (select distinct g, conv_id from keyed) left join (select g, count(*) as n from coded group by g) using (g)
), paths(g, i, s0, s1, s2, s3) as (
    select g, 0::bigint, '000000000', null::varchar, '000000005I', '000000010II' from sizes
    union all
    select g, i, n0, n1, n2, least(m3, [after:n2]) from (
        select *, least(m2, [after:n0], [after:n1], [after:m3]) as n2 from (
            select p.g, c.i, [gone:s0] as n0,
                least([gone:s1], case when not gone and letter = 's' then [kept:s0] end) as n1,
                least([gone:s2], case when not gone then least([new:s0], [new:s1], [new:s3]) end,
                    case when not gone and letter = 'u' then least([kept:s0], [kept:s1], [kept:s3]) end) as m2,
                least([gone:s3], case when not gone then [new:s2] end, case when not gone and letter = 'a' then [kept:s2] end) as m3
            from paths p join coded c on c.g = p.g and c.i = p.i + 1
        )
    )
), solved as (select z.g, z.conv_id, least(s0, s3) as best from sizes z join paths p on p.g = z.g and p.i = z.n
), edits as (
    select g, j, substr(best, 9 + j::integer, 1) as e from (select g, best, unnest(range(1, length(best) - 8)) as j from solved)
), counted as (
    select *, count(*) filter (where e <> 'I') over before_it as i, count(*) filter (where e <> 'D') over before_it as place
    from edits window before_it as (partition by g order by j rows between unbounded preceding and current row)
), joined as (
    select t.*, c.role, c.letter, c.text, max((place = 1 and e = 'K' and letter = 's')::integer) over (partition by t.g) as off
    from counted t left join coded c on c.g = t.g and c.i = t.i and t.e <> 'I' where e <> 'D'
), written as (
    select g, string_agg(case when e = 'K' then role when (place - off) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by place) as body
    from joined group by g
), counts as (
    select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
        count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
        count(*) filter (where following is not null and letter || following not in ('su', 'ua', 'au')) as illegal
    from coded group by g
)
select s.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, substr(best, 1, 9)::bigint as cost, substr(best, 10) as audit,
    sha256(coalesce(body, '')) as repaired_sha256
from solved s left join counts using (g) left join written using (g)
"""
for _mark, _cost, _edit in (("gone", "2", "D"), ("kept", "extra", "K"), ("new", "1 + extra", "R"), ("after", "5", "I")):
    for _state in ("s0", "s1", "s2", "s3", "n0", "n1", "n2", "m3"):
        SQL["op11_conversation_repair"] = SQL["op11_conversation_repair"].replace(f"[{_mark}:{_state}]", _dearer(_state, _cost, _edit))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    digest = hashlib.sha256(vector_codes.listed(books).encode()).hexdigest()
    return vector_codes.with_label_error(rows).select(
        F.col("id").alias("vec_id"), vector_codes.code_string(F.col("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _lloyd_sql(rounds: int) -> str:
    """The rounds one after another: ``a{r}`` assigns parts to the entries ``c{r}``."""
    steps = [r"""
with kept as (
    select row_number() over (order by vec_id nulls last, q) as r, vec_id, label, q from (
        select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
), parts as (
    select r, p, q[p * w + 1:(p + 1) * w] as v from (select r, q, len(q) // 4 as w, unnest(range(4)) as p from kept)
), c0 as (select p, r - 1 as e, v as c from parts where r <= 256)"""]
    for i in range(rounds + 1):
        steps.append(f""", d{i} as (
    select r, parts.p, v, e, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) as d from parts join c{i} on c{i}.p = parts.p
), a{i} as materialized (select r, p, any_value(v) as v, min(struct_pack(d, e)) as best from d{i} group by r, p)""")
        if i < rounds:
            steps.append(f""", s{i} as (
    select p, e, list(floor(total / n) order by place) as c from (
        select p, best.e as e, place, sum(x) as total, count(*) as n from (select p, best, unnest(v) as x, unnest(range(len(v))) as place from a{i}) group by all)
    group by p, e
), c{i + 1} as materialized (select c{i}.p, c{i}.e, coalesce(s{i}.c, c{i}.c) as c from c{i} left join s{i} on s{i}.p = c{i}.p and s{i}.e = c{i}.e)""")
    steps.append(f""", coded as (
    select r, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from a{rounds} group by r
), listed as (
    select sha256(string_agg(x::bigint::varchar, ',' order by p, e, place)) as digest from (select p, e, unnest(c) as x, unnest(range(len(c))) as place from c{rounds})
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, digest as codebooks_sha256
from kept join coded using (r) cross join listed""")
    return "".join(steps)


SQL["op12_vector_codes"] = _lloyd_sql(vector_codes.LLOYD_ROUNDS)


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train(secret_scan.samples(docs, "text"), "value", "secret")
    found = secret_scan.scan(docs, "text", model)
    written = lambda all_: F.array_join(F.transform(all_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
