"""Conversations, answers, scores and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import answers, chat, geometry, images
from tessera.operators import scoring
from tessera.session import load

from .registry import query

TURNS = """
WITH t AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS a FROM conversations GROUP BY 1)
, b AS (SELECT conv_id, CASE WHEN a[1].role = 'user' THEN a ELSE a[2:] END AS b FROM t)
, r AS (SELECT conv_id, CASE WHEN len(b) % 2 = 0 THEN [{'question': b[2*i+1].text, 'answer': b[2*i+2].text} FOR i IN range(len(b) // 2)] END AS r, len(b) AS n FROM b)
"""


def turns(spark, d):
    c = load(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    return g.select("conv_id", F.transform("a", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("a"))


@query(TURNS + "SELECT conv_id, CAST(n AS INT) AS n_turns, CAST(len(r) AS INT) AS n_rounds, r[1].question AS first_question, r[len(r)].answer AS last_answer FROM r")
def chat_rounds(spark, d):
    """Question and answer pairs; null where a turn is unpaired."""
    x = turns(spark, d).withColumn("r", chat.rounds(F.col("a")))
    n = F.size("a") - F.when(F.get("a", F.lit(0))["role"] == "user", 0).otherwise(1)
    return x.select("conv_id", n.alias("n_turns"), F.when(F.col("r").isNotNull(), F.size("r")).alias("n_rounds"), F.get("r", F.lit(0))["question"].alias("first_question"), F.try_element_at("r", F.lit(-1))["answer"].alias("last_answer"))


PROMPT = TURNS + f", p AS (SELECT conv_id, r, CASE WHEN len(r) > 0 THEN '{chat.SYSTEM.replace(chr(39), chr(39) * 2)} ' || array_to_string([('USER: ' || q.question || ' ASSISTANT: ' || q.answer || '</s>') FOR q IN r], '') WHEN len(r) = 0 THEN '' END AS prompt FROM r)"


@query(PROMPT + " SELECT conv_id, prompt, CAST(length(prompt) AS INT) AS n FROM p")
def chat_prompt(spark, d):
    x = turns(spark, d).select("conv_id", chat.prompt(chat.rounds(F.col("a")), chat.template("llama")).alias("prompt"))
    return x.withColumn("n", F.length("prompt"))


@query("SELECT conv_id, CAST(CASE WHEN conv_id % 4 = 0 THEN 128 + sum(k) ELSE -sum(k) END AS BIGINT) AS length FROM (SELECT conv_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS k FROM conversations) GROUP BY conv_id")
def conv_lengths(spark, d):
    """Words per conversation, 128 more for an image, negative without one."""
    n = F.sum(F.size(chat.words(F.col("text"))))
    g = load(spark, d, "conversations").groupBy("conv_id").agg(n.alias("n"))
    return g.select("conv_id", F.when(F.col("conv_id") % 4 == 0, F.col("n") + 128).otherwise(-F.col("n")).alias("length"))


@query(TURNS + ", w AS (SELECT conv_id, len(list_filter(regexp_split_to_array(q.question, '\\s+'), lambda w: w <> '')) AS a, len(list_filter(regexp_split_to_array(q.answer, '\\s+'), lambda w: w <> '')) AS b FROM (SELECT conv_id, unnest(r) AS q FROM r WHERE len(r) > 0)) SELECT conv_id, CAST(sum(a + b) AS INT) AS n_tokens, CAST(sum(b) AS INT) AS n_learnt FROM w GROUP BY 1")
def label_mask(spark, d):
    size = lambda c: F.size(chat.words(c))
    r = turns(spark, d).select("conv_id", chat.rounds(F.col("a")).alias("r")).where("size(r) > 0")
    m = chat.label_mask(F.col("r"), lambda p: size(p["question"]), lambda p: size(p["answer"]))
    return r.select("conv_id", m.alias("m")).select("conv_id", F.size("m").alias("n_tokens"), F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("n_learnt"))


@query("WITH w AS (SELECT item_id, item_id // 8 AS batch, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM benchmark), m AS (SELECT *, least(max(len(w)) OVER (PARTITION BY batch), 40) AS n FROM w) SELECT item_id, CAST(n AS INT) AS width, CAST(least(len(w), n) AS INT) AS n_attended, CAST(n - least(len(w), n) AS INT) AS n_padded FROM m")
def pad_mask(spark, d):
    """Token ids filled to their batch's width, at most 40, and the mask of original length."""
    from pyspark.sql import Window

    ids = chat.image_tokens(F.col("text"))
    x = load(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 8).alias("batch"), ids.alias("ids"))
    x = x.withColumn("n", F.least(F.max(F.size("ids")).over(Window.partitionBy("batch")), F.lit(40)))
    x = x.withColumn("p", chat.padded(F.col("ids"), F.col("n"), 0)).withColumn("m", chat.attention(F.col("ids"), F.col("n")))
    return x.select("item_id", F.size("p").alias("width"), F.aggregate("m", F.lit(0), lambda a, v: a + v).alias("n_attended"), F.size(F.filter("m", lambda v: v == 0)).alias("n_padded"))


@query("WITH x AS (SELECT item_id, text || ' <image> tail' AS t FROM benchmark), w AS (SELECT item_id, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS w FROM x) SELECT item_id, CAST(len(w) AS INT) AS n_tokens, CAST(list_position(w, '<image>') AS INT) AS image_at FROM w")
def image_tokens(spark, d):
    """The image mark becomes one id of its own among the token ids."""
    x = load(spark, d, "benchmark").select("item_id", chat.image_tokens(F.concat("text", F.lit(" <image> tail"))).alias("t"))
    return x.select("item_id", F.size("t").alias("n_tokens"), F.array_position("t", F.lit(chat.IMAGE_ID)).cast("int").alias("image_at"))


@query("SELECT item_id, CAST(len(w) - 1 + 5 AS INT) AS n, CAST(5 AS INT) AS n_spliced FROM (SELECT item_id, list_filter(regexp_split_to_array(text || ' <image> tail', '\\s+'), lambda w: w <> '') AS w FROM benchmark)")
def feature_splice(spark, d):
    """One mark replaced by a run of five image positions, labels masked there."""
    x = load(spark, d, "benchmark").select("item_id", chat.image_tokens(F.concat("text", F.lit(" <image> tail"))).alias("t"))
    out = F.flatten(F.transform("t", lambda v: F.when(v == chat.IMAGE_ID, F.array_repeat(F.lit(chat.IGNORE), 5)).otherwise(F.array(v))))
    return x.select("item_id", out.alias("o")).select("item_id", F.size("o").alias("n"), F.size(F.filter("o", lambda v: v == chat.IGNORE)).alias("n_spliced"))


@query("SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:10], ' ') AS head FROM benchmark")
def truncate_seq(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(F.slice(chat.words(F.col("text")), 1, 10), " ").alias("head"))


@query("SELECT item_id, split_part(text, 'the', 1) AS stopped FROM benchmark")
def stop_words(spark, d):
    return load(spark, d, "benchmark").select("item_id", chat.stop_at(F.col("text"), "the").alias("stopped"))


RAW = "CASE WHEN turn % 4 = 0 THEN 'The ' || text || ', two (dogs) dont. a..b 1.5' WHEN turn % 4 = 1 THEN 'No, it is not. ' || text WHEN turn % 4 = 2 THEN substr(text, 1, 40) || '...' ELSE text END"


def raw(spark, d):
    t = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("The "), "text", F.lit(", two (dogs) dont. a..b 1.5"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("No, it is not. "), "text")).when(F.col("turn") % 4 == 2, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text"))
    return load(spark, d, "conversations").select("conv_id", "turn", t.alias("raw"))


def _marks_sql(x: str) -> str:
    out = x
    for m in answers.MARKS:
        m = m.replace("'", "''")
        out = f"replace({out}, '{m}', CASE WHEN contains({x}, '{m} ') OR contains({x}, ' {m}') OR regexp_matches({x}, '[0-9],[0-9]') THEN '' ELSE ' ' END)"
    return f"regexp_replace(regexp_replace({out}, '\\.+([^0-9.]|$)', '\\1', 'g'), '\\.+(\\.[0-9])', '\\1', 'g')"


def _map_sql(d: dict) -> str:
    q = lambda s: s.replace("'", "''")
    return "MAP {" + ", ".join(f"'{q(k)}': '{q(v)}'" for k, v in d.items()) + "}"


NORMAL = f"""
WITH x AS (SELECT conv_id, turn, {RAW} AS raw FROM conversations)
, t AS (SELECT *, trim(translate(trim(replace(replace(replace(lower(raw), ',', ''), '?', ''), '''s', ' ''s'), E' \\n\\t\\r'), E'\\n\\t', '  '), E' \\n\\t\\r') AS t FROM x)
, p AS (SELECT *, {_marks_sql('t')} AS p FROM t)
, w AS (SELECT *, list_filter([coalesce({_map_sql(answers.NUMBERS)}[w], w) FOR w IN list_filter(regexp_split_to_array(lower(p), '\\s+'), lambda w: w <> '')], lambda w: w NOT IN ('a', 'an', 'the')) AS w FROM p)
SELECT conv_id, turn, array_to_string([coalesce({_map_sql(answers.CONTRACTIONS)}[v], v) FOR v IN w], ' ') AS normalized FROM w
"""


@query(NORMAL)
def answer_norm(spark, d):
    return raw(spark, d).select("conv_id", "turn", answers.normalize(F.col("raw")).alias("normalized"))


@query(f"SELECT conv_id, turn, CASE WHEN list_has_any(string_split(replace(split_part({RAW}, '.', 1), ',', ''), ' '), ['No', 'not', 'no']) THEN 'no' ELSE 'yes' END AS parsed FROM conversations")
def yes_no(spark, d):
    return raw(spark, d).select("conv_id", "turn", answers.yes_no(F.col("raw")).alias("parsed"))


@query(f"SELECT conv_id, turn, lower(regexp_replace({RAW}, '\\.+$', '')) AS norm FROM conversations")
def gqa_norm(spark, d):
    return raw(spark, d).select("conv_id", "turn", answers.rstrip_stops(F.col("raw")).alias("norm"))


LETTER = "CASE WHEN conv_id % 5 = 0 THEN 'B' WHEN conv_id % 5 = 1 THEN 'C. ' || text WHEN conv_id % 5 = 2 THEN text || ' The answer is D.' WHEN conv_id % 5 = 3 THEN 'The answer is A. The answer is B. ' ELSE 'The answer is C' END"
LETTER_SQL = f"WITH x AS (SELECT conv_id, turn, {LETTER} AS t FROM conversations), y AS (SELECT *, regexp_extract_all(t, '(?s)The answer is ([A-Z])[^\\n]', 1) AS f FROM x), z AS (SELECT *, CASE WHEN t IN ('A','B','C','D','E') THEN t WHEN regexp_matches(t, '^[ABCDE]\\. ') THEN t[1] WHEN len(f) = 1 THEN f[1] ELSE 'FAILED' END AS letter FROM y)"


def letters(spark, d):
    m = F.col("conv_id") % 5
    t = F.when(m == 0, "B").when(m == 1, F.concat(F.lit("C. "), "text")).when(m == 2, F.concat("text", F.lit(" The answer is D."))).when(m == 3, "The answer is A. The answer is B. ").otherwise("The answer is C")
    x = load(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))
    return x.withColumn("letter", answers.choice_letter(F.col("t")))


@query(LETTER_SQL + " SELECT conv_id, turn, letter, CAST(coalesce(list_position(['A','B','C','D','E'][1:CAST(2 + turn % 3 AS INT)], letter), 0) - 1 AS INT) AS idx FROM z")
def mc_letter(spark, d):
    return letters(spark, d).select("conv_id", "turn", "letter", answers.choice_index(F.col("letter"), (2 + F.col("turn") % 3).cast("int")).alias("idx"))


@query(LETTER_SQL + " SELECT count(*) AS n, round(avg(CASE WHEN letter = 'B' THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS accuracy, round(avg(CASE WHEN letter = 'B' THEN 1.0::DOUBLE ELSE 0 END) FILTER (turn = 0) * 100, 6) AS image_accuracy FROM z")
def sqa_accuracy(spark, d):
    """Accuracy of all and of the part with images; null if that is empty."""
    ok = F.when(F.col("letter") == "B", 1.0).otherwise(0.0)
    return letters(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok) * 100, 6).alias("accuracy"), F.round(F.avg(F.when(F.col("turn") == 0, ok)) * 100, 6).alias("image_accuracy"))


CHOICES = (("A", "red rock"), ("B", "blue sea"), ("C", "Green tree"))
NAMED = "WITH x AS (SELECT conv_id, turn, text || CASE conv_id % 3 WHEN 0 THEN ' So (' || ['A','B','C'][CAST(1 + turn % 3 AS INT)] || ') it is!' WHEN 1 THEN ' maybe ' || ['A','B','C'][CAST(1 + turn % 3 AS INT)] || ' !' ELSE ' it must be some kind of big green tree here' END AS t FROM conversations)"
LAST = "x"
for _c in (",", ".", "!", "?", ";", ":", "''"):  # the marks go one after the other
    NAMED += f", x{ord(_c[0])} AS (SELECT conv_id, turn, regexp_replace(t, '^[{_c}]+|[{_c}]+$', '', 'g') AS t FROM {LAST})"
    LAST = f"x{ord(_c[0])}"


@query(NAMED + f", f AS (SELECT conv_id, turn, i, l, p, CASE p WHEN 3 THEN lower(' ' || t || ' ') ELSE ' ' || t || ' ' END AS h, CASE p WHEN 1 THEN '(' || l || ')' WHEN 2 THEN ' ' || l || ' ' ELSE lower(a) END AS form FROM {LAST}, (VALUES (1, 'A', 'red rock'), (2, 'B', 'blue sea'), (3, 'C', 'Green tree')) o(i, l, a), range(1, 4) q(p)), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p, strpos(reverse(h), reverse(form)) + length(form), i) AS rn FROM f WHERE contains(h, form)) SELECT conv_id, turn, l AS letter FROM b WHERE rn = 1")
def multi_choice(spark, d):
    """Letters named last in free responses: in brackets, alone, or by an answer's text; a response to every turn of all conversations."""
    letter = F.get(F.array(*[F.lit(k) for k, _ in CHOICES]), (F.col("turn") % 3).cast("int"))
    m = F.col("conv_id") % 3
    end = F.when(m == 0, F.concat(F.lit(" So ("), letter, F.lit(") it is!"))).when(m == 1, F.concat(F.lit(" maybe "), letter, F.lit(" !"))).otherwise(" it must be some kind of big green tree here")
    o = F.array(*[F.struct(F.lit(k).alias("letter"), F.lit(v).alias("answer")) for k, v in CHOICES])
    return load(spark, d, "conversations").select("conv_id", "turn", F.concat("text", end).alias("t")).select("conv_id", "turn", answers.multi_choice(F.col("t"), o).alias("letter"))


@query("WITH x AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'OCR tokens: a b\nQuestion: ' || text || ' Short answer:' WHEN item_id % 3 = 1 THEN replace(text, E'\n', ' ') || '\nReference OCR token: x\nAnswer' ELSE replace(text, E'\n', ' ') || '\nAnswer briefly' END AS p FROM benchmark) SELECT item_id, lower(CASE WHEN p LIKE 'OCR tokens: %' THEN regexp_extract(p, '(?s)Question: (.*?) Short answer:', 1) ELSE split_part(p, E'\n', 1) END) AS question FROM x".replace("\n", "\\n").replace("'OCR tokens: a b\\n", "E'OCR tokens: a b\\n").replace("'\\nReference", "E'\\nReference").replace("'\\nAnswer briefly", "E'\\nAnswer briefly"))
def prompt_question(spark, d):
    """The question in each of three prompt layouts."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    p = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("OCR tokens: a b\nQuestion: "), F.col("text"), F.lit(" Short answer:"))).when(F.col("item_id") % 3 == 1, F.concat(flat, F.lit("\nReference OCR token: x\nAnswer"))).otherwise(F.concat(flat, F.lit("\nAnswer briefly")))
    lines = F.split("p", "\n")
    at = F.when(F.startswith("p", F.lit("Reference OCR token:")), F.get(lines, F.lit(1))).otherwise(F.get(lines, F.lit(0)))
    q = F.when(F.startswith("p", F.lit("OCR tokens: ")), F.regexp_extract("p", "(?s)Question: (.*?) Short answer:", 1)).when(F.contains("p", F.lit("Reference OCR token: ")) & (F.size(lines) == 3), at).when(F.size(lines) == 2, F.get(lines, F.lit(0))).otherwise(F.raise_error("unknown prompt layout"))
    return load(spark, d, "benchmark").select("item_id", p.alias("p")).select("item_id", F.lower(q).alias("question"))


PAIRED = "WITH x AS (SELECT conv_id, turn, CAST((conv_id + turn) % 3 = 0 AS INT) AS pred, CAST(conv_id % 2 AS INT) AS label FROM conversations)"
POPE = PAIRED + ", c AS (SELECT count_if(pred=1 AND label=1) AS tp, count_if(pred=1 AND label=0) AS fp, count_if(pred=0 AND label=0) AS tn, count_if(pred=0 AND label=1) AS fn FROM x), r AS (SELECT *, tp / (tp + fp + 1e-6::DOUBLE) AS p, tp / (tp + fn + 1e-6::DOUBLE) AS r FROM c)"


@query(POPE + " SELECT tp, fp, tn, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r + 1e-6::DOUBLE), 9) AS f1, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 9) AS accuracy, round(CAST(tp + fp AS DOUBLE) / (tp + tn + fp + fn), 9) AS yes_ratio FROM r")
def yes_no_scores(spark, d):
    c = load(spark, d, "conversations")
    x = c.select(((F.col("conv_id") + F.col("turn")) % 3 == 0).cast("int").alias("pred"), (F.col("conv_id") % 2).cast("int").alias("label"))
    return scoring.yes_no_scores(x, "pred", "label")


@query("SELECT role, count(*) AS n, count_if(role = 'user') AS n_user FROM conversations JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') s USING (conv_id) GROUP BY 1")
def category_answers(spark, d):
    """Answers joined with their questions and filtered by the questions' category."""
    c = load(spark, d, "conversations")
    q = c.where("role = 'system'").select("conv_id").distinct()
    return c.join(q, "conv_id", "left_semi").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("n_user"))


ANSWERS = "WITH a AS (SELECT b.item_id, [substr(b.text, CAST(1 + (b.item_id + i) % 3 AS INT)) FOR i IN range(10)] AS answers, substr(text, 2) AS pred FROM benchmark b), m AS (SELECT *, CAST(len(list_filter(answers, lambda x: x = pred)) AS DOUBLE) AS m FROM a)"


def ten_answers(spark, d):
    b = load(spark, d, "benchmark")
    ten = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.expr("text").substr((1 + (F.col("item_id") + i) % 3).cast("int"), F.length("text")))
    return b.select("item_id", ten.alias("answers"), F.expr("substr(text, 2)").alias("pred"))


@query(ANSWERS + " SELECT item_id, round((m * least(1.0::DOUBLE, (m - 1) / 3) + (10 - m) * least(1.0::DOUBLE, m / 3)) / 10, 9) AS acc FROM m")
def vqa_soft_acc(spark, d):
    return ten_answers(spark, d).select("item_id", F.round(scoring.soft_accuracy(F.col("pred"), F.col("answers")), 9).alias("acc"))


@query(ANSWERS + " SELECT item_id, CAST(list_contains(answers, pred) AS INT) AS hit FROM m")
def exact_match(spark, d):
    return ten_answers(spark, d).select("item_id", scoring.exact_match(F.col("pred"), F.col("answers")).alias("hit"))


ASCII = "regexp_replace({0}, '[^ -~]', '', 'g')"


@query(f"WITH x AS (SELECT a.item_id, trim(lower({ASCII.format('a.text')})) AS p, [trim(lower({ASCII.format('b.text')})), trim(lower({ASCII.format('a.text')}))[2:]] AS g FROM (SELECT *, (item_id + 1) % (SELECT count(*) FROM benchmark) AS nxt FROM benchmark) a JOIN benchmark b ON b.item_id = a.nxt) SELECT item_id, round(list_max([CASE WHEN 1 - CAST(levenshtein(p, v) AS DOUBLE) / greatest(length(p), length(v)) < 0.5 THEN 0.0::DOUBLE ELSE 1 - CAST(levenshtein(p, v) AS DOUBLE) / greatest(length(p), length(v)) END FOR v IN g]), 9) AS anls FROM x")
def anls(spark, d):
    b = load(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    nxt = b.select(F.col("item_id").alias("j"), F.col("t").alias("u"))
    x = b.join(nxt, (F.col("item_id") + 1) % b.count() == F.col("j"))
    own = F.lower(F.trim("t"))
    return x.select("item_id", F.round(scoring.anls(F.col("t"), F.array("u", own.substr(F.lit(2), F.length(own)))), 9).alias("anls"))


BLEU = """
WITH x AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS r FROM benchmark)
, y AS (SELECT id, r, CASE WHEN id % 2 = 0 THEN r ELSE r[3:] END AS p FROM x)
, l AS (SELECT sum(len(p)) AS lp, sum(len(r)) AS lr FROM y)
, gp AS (SELECT id, n, array_to_string(p[i:i+n-1], ' ') AS g, count(*) AS c FROM y, range(1, 5) a(n), LATERAL (SELECT unnest(range(1, len(p) - n + 2)) AS i) GROUP BY ALL)
, gr AS (SELECT id, n, array_to_string(r[i:i+n-1], ' ') AS g, count(*) AS c FROM y, range(1, 5) a(n), LATERAL (SELECT unnest(range(1, len(r) - n + 2)) AS i) GROUP BY ALL)
, m AS (SELECT n, sum(least(gp.c, coalesce(gr.c, 0))) AS m, sum(gp.c) AS t FROM gp LEFT JOIN gr USING (id, n, g) GROUP BY 1)
SELECT CAST(lp AS BIGINT) AS pred_words, CAST(lr AS BIGINT) AS ref_words, round(CASE WHEN lp < lr THEN exp(1 - CAST(lr AS DOUBLE) / lp) ELSE 1 END * (SELECT exp(avg(ln(CAST(m AS DOUBLE) / t))) FROM m), 9) AS bleu FROM l
"""


@query(BLEU)
def bleu4(spark, d):
    """Corpus BLEU over white-space words; every other prediction lacks its first two words."""
    w = chat.words(F.col("text"))
    p = F.when(F.col("item_id") % 2 == 0, F.array_join(w, " ")).otherwise(F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))), " "))
    return scoring.bleu(load(spark, d, "benchmark").select("item_id", p.alias("p0"), F.col("text").alias("r0")).withColumnsRenamed({"p0": "pred", "r0": "ref"}), "pred", "ref", "item_id")


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN -1 ELSE item_id % 2 END AS result, CAST(length(text) AS INT) AS n FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0)")
def annotated_results(spark, d):
    """Results joined with annotations on id and lower-cased question; some ids have two results, some two annotations, of which the last counts."""
    b = load(spark, d, "benchmark")
    notes = b.select("item_id", F.upper("text").alias("question"), (F.col("item_id") % 2).alias("result"), F.lit(1).alias("line"))
    notes = notes.unionByName(b.where("item_id % 3 = 0").select("item_id", F.col("text").alias("question"), F.lit(-1).cast("long").alias("result"), F.lit(2).alias("line")))
    results = b.unionByName(b.where("item_id % 2 = 0")).select("item_id", F.col("text").alias("question"))
    return scoring.annotated(results, notes, "item_id", "question", "line").select("item_id", "result", F.length("question").alias("n"))


@query("WITH s AS (SELECT doc_id FROM documents WHERE doc_id % 4 = 0), p AS (SELECT doc_id, CAST(quality AS VARCHAR) AS t FROM labels) SELECT s.doc_id, coalesce(t, 'FAILED') AS pred FROM s LEFT JOIN p USING (doc_id)")
def split_predictions(spark, d):
    """The ids of a split with their predictions, FAILED where there is none."""
    s = load(spark, d, "documents").where("doc_id % 4 = 0").select("doc_id")
    p = load(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("t"))
    return s.join(p, "doc_id", "left").select("doc_id", F.coalesce("t", F.lit("FAILED")).alias("pred"))


@query("SELECT p_partkey, trim(w) AS path, CAST(i AS INT) AS place FROM (SELECT p_partkey, unnest(string_split(p_type || '.png|' || p_brand || '.jpg', '|')) AS w, generate_subscripts(string_split(p_type || '.png|' || p_brand || '.jpg', '|'), 1) - 1 AS i FROM part)")
def image_list(spark, d):
    """A delimited list of paths opened to rows."""
    paths = F.split(F.concat("p_type", F.lit(".png|"), "p_brand", F.lit(".jpg")), r"\|")
    return load(spark, d, "part").select("p_partkey", F.posexplode(paths).alias("place", "w")).select("p_partkey", F.trim("w").alias("path"), "place")


@query(TURNS + "SELECT conv_id, CAST(n + 2 AS INT) AS n_turns, CASE WHEN r IS NOT NULL THEN CAST(len(r) + 1 AS INT) END AS n_pairs FROM r")
def conversation_build(spark, d):
    """Another round appended, an answer left open, and the pairs shown."""
    x = turns(spark, d)
    drop = F.when(F.get("a", F.lit(0))["role"] == "user", 0).otherwise(1)
    more = F.concat("a", F.array(F.struct(F.lit("user").alias("role"), F.lit("why?").alias("text")), F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("text"))))
    r = chat.rounds(more)
    return x.select("conv_id", (F.size(more) - drop).alias("n_turns"), F.when(r.isNotNull(), F.size(r)).alias("n_pairs"))


SIZES = ((336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008))
DIMS = "SELECT p_partkey, CAST(100 + p_size * 17 AS INT) AS w, CAST(80 + (p_partkey % 50) * 23 AS INT) AS h FROM part"


def dims(spark, d):
    return load(spark, d, "part").select("p_partkey", (100 + F.col("p_size") * 17).cast("int").alias("w"), (80 + F.col("p_partkey") % 50 * 23).cast("int").alias("h"))


@query(f"WITH x AS ({DIMS}), c AS (SELECT * FROM (VALUES {', '.join(f'({i},{a},{b})' for i, (a, b) in enumerate(SIZES))}) t(i, cw, ch)), e AS (SELECT *, least(CAST(trunc(w * least(CAST(cw AS DOUBLE)/w, CAST(ch AS DOUBLE)/h)) AS BIGINT) * CAST(trunc(h * least(CAST(cw AS DOUBLE)/w, CAST(ch AS DOUBLE)/h)) AS BIGINT), CAST(w AS BIGINT) * h) AS eff FROM x, c), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY eff DESC, cw * ch - eff, i) AS rn FROM e) SELECT p_partkey, CAST(cw AS INT) AS best_w, CAST(ch AS INT) AS best_h, CAST(cw // 336 AS INT) AS grid_w, CAST(ch // 336 AS INT) AS grid_h FROM r WHERE rn = 1")
def best_resolution(spark, d):
    x = dims(spark, d).withColumn("b", geometry.best_resolution(F.col("w"), F.col("h"), list(SIZES)))
    cell = lambda c: F.floor(c / 336).cast("int")
    return x.select("p_partkey", F.col("b.width").alias("best_w"), F.col("b.height").alias("best_h"), cell(F.col("b.width")).alias("grid_w"), cell(F.col("b.height")).alias("grid_h"))


@query(f"WITH x AS ({DIMS}) SELECT p_partkey, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(a + 336 AS INT) AS \"right\", CAST(b + 336 AS INT) AS bottom FROM x, LATERAL (SELECT unnest(range(0, w, 336)) AS a), LATERAL (SELECT unnest(range(0, h, 336)) AS b)")
def tiles(spark, d):
    return dims(spark, d).select("p_partkey", F.explode(geometry.tile_boxes(F.col("w"), F.col("h"), 336)).alias("t")).select("p_partkey", "t.*")


@query(f"WITH x AS ({DIMS}), s AS (SELECT *, 672.0::DOUBLE / w AS sw, 336.0::DOUBLE / h AS sh FROM x), n AS (SELECT *, CASE WHEN sw < sh THEN 672 ELSE least(CAST(ceil(w * sh) AS INT), 672) END AS nw, CASE WHEN sw < sh THEN least(CAST(ceil(h * sw) AS INT), 336) ELSE 336 END AS nh FROM s) SELECT p_partkey, CAST(nw AS INT) AS new_width, CAST(nh AS INT) AS new_height, CAST((672 - nw) // 2 AS INT) AS x, CAST((336 - nh) // 2 AS INT) AS y, CAST(greatest(w, h) AS INT) AS side FROM n")
def resize_pad(spark, d):
    f = geometry.fit_and_pad(F.col("w"), F.col("h"), F.lit(672), F.lit(336))
    return dims(spark, d).withColumn("f", f).select("p_partkey", "f.new_width", "f.new_height", "f.x", "f.y", geometry.square_offsets(F.col("w"), F.col("h"))["side"].alias("side"))


@query(
    f"""
WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' ELSE 'jpeg' END AS kind, CAST(100 + n_chars % 1900 AS INT) AS w, CAST(80 + doc_id % 1200 AS INT) AS h FROM documents)
, c AS (SELECT * FROM (VALUES {', '.join(f'({i},{a},{b})' for i, (a, b) in enumerate(SIZES))}) t(i, cw, ch))
, e AS (SELECT *, least(CAST(trunc(w * least(CAST(cw AS DOUBLE)/w, CAST(ch AS DOUBLE)/h)) AS BIGINT) * CAST(trunc(h * least(CAST(cw AS DOUBLE)/w, CAST(ch AS DOUBLE)/h)) AS BIGINT), CAST(w AS BIGINT) * h) AS eff FROM x, c)
, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY eff DESC, cw * ch - eff, i) AS rn FROM e)
SELECT doc_id, kind, w AS width, h AS height, CAST(cw AS INT) AS best_w, CAST(ch AS INT) AS best_h FROM r WHERE rn = 1
"""
)
def image_sizes(spark, d):
    """Pictures as base64 text, their sizes read from the headers, and the resolution that fits each best."""
    w, h = 100 + F.col("n_chars") % 1900, 80 + F.col("doc_id") % 1200
    hexed = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    swapped = lambda c: F.concat(F.substring(hexed(c, 2), 3, 2), F.substring(hexed(c, 2), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w, 4), hexed(h, 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), swapped(w), swapped(h), F.lit("F70000"))
    comment = F.concat(F.lit("FFFE"), hexed(F.octet_length("text") % 60000 + 2, 2), F.hex(F.substring(F.encode("text", "UTF-8"), F.lit(1), F.octet_length("text") % 60000)))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), comment, F.lit("FFC2001108"), hexed(h, 2), hexed(w, 2), F.lit("03012200"))
    data = F.when(F.col("doc_id") % 3 == 0, png).when(F.col("doc_id") % 3 == 1, gif).otherwise(jpeg)
    text = F.concat(F.lit("data:image/x;base64,"), F.base64(F.unhex(data)))
    got = load(spark, d, "documents").select("doc_id", images.from_base64(text).alias("data"))
    got = got.select("doc_id", images.size(F.col("data")).alias("s")).select("doc_id", "s.*")
    got = got.withColumn("b", geometry.best_resolution(F.col("width"), F.col("height"), list(SIZES)))
    return got.select("doc_id", "kind", "width", "height", F.col("b.width").alias("best_w"), F.col("b.height").alias("best_h"))
