"""Conversation templates: rounds, prompts, image tokens, label masks, padding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE, IGNORE = "<image>", -100
IMAGE_ID = -200

# The system sentence and the closing mark of each template.
SYSTEM = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
ENDS = {"llama": "</s>", "phi": "<|endoftext|>", "gemma": "<eos>", "qwen2_base": "<|endoftext|>", "qwen2_instruct": "<|im_end|>"}
# Fixed values end.


@dataclass(frozen=True)
class Template:
    system: str
    user: str
    assistant: str
    image: str
    end: str


TEMPLATES = {name: Template(SYSTEM + " ", "USER: {} ", "ASSISTANT: {}" + end, IMAGE + "\n{}", end) for name, end in ENDS.items()}
TEMPLATES["pretrain"] = Template("", IMAGE, "{}\n", "", "")


def template(name: str) -> Template:
    """By exact name; the registry keeps the first that registers."""
    return TEMPLATES[name]


def register(name: str, t: Template) -> Template:
    return TEMPLATES.setdefault(name, t)


def slot(form: str, content: Column) -> Column:
    """The form with its content; a null content leaves the text before the colon, with it."""
    before, mark, after = form.partition("{}")
    if not mark:
        return F.lit(form)
    return F.when(content.isNull(), form.split(":")[0] + ":").otherwise(F.concat(F.lit(before), content, F.lit(after)))


def rounds(turns: Column) -> Column:
    """(question, answer) pairs of an ordered array of (role, text).

    A first turn that isn't the human's is dropped; then questions and answers alternate. Null if one is missing.
    """
    body = F.when(F.get(turns, F.lit(0))["role"] == "user", turns).otherwise(F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0))))
    pair = lambda i: F.struct(F.element_at(body, 2 * i + 1)["text"].alias("question"), F.element_at(body, 2 * i + 2)["text"].alias("answer"))
    n = (F.size(body) / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<struct<question:string,answer:string>>"))
    return F.when(F.size(body) % 2 == 0, pairs)


def prompt(pairs: Column, t: Template) -> Column:
    """System text, then each round; an image mark moves to the front of its question."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def one(p):
        q = p["question"]
        with_image = trim(slot(t.image, trim(F.replace(q, F.lit(IMAGE), F.lit(""))))) if "{}" in t.image else F.lit(t.image)
        return F.concat(slot(t.user, F.when(F.contains(q, F.lit(IMAGE)), with_image).otherwise(q)), slot(t.assistant, p["answer"]))

    return F.when(F.size(pairs) > 0, F.concat(F.lit(t.system), F.array_join(F.transform(pairs, one), ""))).when(F.size(pairs) == 0, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def image_tokens(text: Column, tokenize=None) -> Column:
    """Token ids with IMAGE_ID where the image mark stood. The default tokenizer hashes words to 0..32767."""
    tokenize = tokenize or (lambda x: F.transform(words(x), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(32768)).cast("int")))
    parts = F.transform(F.split(text, IMAGE), lambda x, i: F.when(i == 0, tokenize(x)).otherwise(F.concat(F.array(F.lit(IMAGE_ID)), tokenize(x))))
    return F.flatten(parts)


def label_mask(pairs: Column, ask, reply) -> Column:
    """1 where a token is to be learnt: a round's ``ask(p)`` tokens are masked, its ``reply(p)`` tokens are not."""
    ones = lambda v, n: F.array_repeat(F.lit(v), n.cast("int"))
    return F.flatten(F.transform(pairs, lambda p: F.concat(ones(0, ask(p)), ones(1, reply(p)))))


def padded(ids: Column, length: Column, pad: int) -> Column:
    """Cut or filled up to ``length``."""
    return F.concat(F.slice(ids, F.lit(1), F.least(F.size(ids), length)), F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0))))


def attention(ids: Column, length: Column) -> Column:
    """1 for each token of the original length, whatever id is used to pad."""
    n = F.least(F.size(ids), length)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))


def stop_at(text: Column, stop: str) -> Column:
    """Generated text before its first stop word."""
    return F.substring_index(text, stop, 1)
