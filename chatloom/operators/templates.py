"""Chat templates: rendering, the spans that are supervised, and their labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    assistant: str | None
    user: str | None
    system: str | None
    end: str | None
    parser: str = "general"
    spans: str = "general"
    thinking: bool = False
    ignored: tuple[str, ...] = ()


_HELPFUL = "You are a helpful assistant."
_IM = Template("<|im_start|>assistant\n", "<|im_start|>user\n", _HELPFUL, "<|im_end|>\n")
_THINK = replace(_IM, parser="thinking", thinking=True)
_BAR = Template("<｜Assistant｜>", "<｜User｜>", _HELPFUL, "<｜end▁of▁sentence｜>")
_KIMI = Template("<|im_assistant|>assistant<|im_middle|>", "<|im_start|>user\n", _HELPFUL, "<|im_end|>")
#: The headers and terminators that models' templates print.
TEMPLATES: dict[str, Template] = {
    "llama3": Template(
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
        "<|start_header_id|>user<|end_header_id|>",
        "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information.",
        "<|eot_id|>",
    ),
    "llama4": Template("<|header_start|>assistant<|header_end|>\n\n", "<|header_start|>user<|header_end|>", _HELPFUL, "<|eot|>"),
    "qwen": _IM,
    "lfm": replace(_IM, system=""),
    "phi3": Template("<|assistant|>\n", "<|user|>\n", _HELPFUL, "<|end|>\n"),
    "phi4": Template("<|im_start|>assistant<|im_sep|>", "<|im_start|>user<|im_sep|>", _HELPFUL, "<|im_end|>"),
    "phi4-mini": Template("<|assistant|>", "<|user|>", _HELPFUL, "<|end|>"),
    "gpt-oss-naive": Template("<|start|>assistant<|channel|>analysis<|message|>", "<|start|>user<|message|>", None, "<|end|>"),
    "gpt-oss": Template(None, None, None, None, parser="openai-harmony"),
    "deepseek-r1-distill": replace(_BAR, system=None, end=None),
    "qwen3-thinking": _THINK,
    "qwen3-instruct": replace(_IM, ignored=("<think>\n\n</think>\n\n",)),
    "qwen3-next-thinking": replace(_THINK, assistant="<|im_start|>assistant\n<think>\n"),
    "kimi-k2-thinking": replace(_KIMI, parser="thinking", thinking=True),
    "kimi-k2-instruct": _KIMI,
    "kimi-k3-thinking": Template('<|open|>message role="assistant"<|sep|><|open|>think<|sep|>', '<|open|>message role="user"<|sep|>', None, "<|end_of_msg|>", parser="thinking", ignored=("<|end_of_msg|>",)),
    "deepseek-v3": _BAR,
    "deepseek-v2": Template("Assistant: ", "User: ", None, "<｜end▁of▁sentence｜>"),
    "ling-flash-2.0": Template("<role>ASSISTANT</role>", "<role>HUMAN</role>", _HELPFUL, "<|role_end|>"),
    "deepseek-v32": replace(_BAR, system="", parser="thinking", thinking=True),
    "glm-5.2": Template("<|assistant|><think>", "<|user|>", None, "<|user|>", parser="glm", spans="glm", ignored=("<|user|>",)),
    "gemma": Template("<start_of_turn>model\n", "<start_of_turn>user\n", _HELPFUL, "<end_of_turn>\n"),
    "longcat": Template(" ASSISTANT:", " USER:", _HELPFUL, "</longcat_s>", spans="longcat"),
    "longcat_xml": Template("<longcat_assistant>", "<longcat_user>", _HELPFUL, "</longcat_s>"),
    "qwen3.5": replace(_THINK, assistant="<|im_start|>assistant\n<think>\n", system=""),
    "inkling-thinking": Template("<|message_model|>", "<|message_user|>", None, "<|message_user|>", parser="thinking", spans="inkling", thinking=True, ignored=("<|message_user|>", "<|message_tool|>", "<|message_system|>")),
}


def register(name: str, template: Template, override: bool = False) -> None:
    if name in TEMPLATES and not override:
        raise ValueError(f"template {name} is registered")
    TEMPLATES[name] = template


def render(messages: Column, template: Template, bos: str = "") -> Column:
    """Plain rendering: ``bos``, then system texts as they are, users under their header,
    assistants under theirs with the terminator; other roles are not printed."""
    def one(m: Column) -> Column:
        text = F.coalesce(m["content"], F.lit(""))
        return (
            F.when(m["role"] == "system", text)
            .when(m["role"] == "user", F.concat(F.lit(template.user or ""), text))
            .when(m["role"] == "assistant", F.concat(F.lit(template.assistant or ""), text, F.lit(template.end or "")))
            .otherwise(F.lit(""))
        )

    return F.concat(F.lit(bos), F.array_join(F.transform(messages, one), ""))


#: The system text that a conversation without one gets, in its parts.
HARMONY_SYSTEM = "<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\nCurrent date: 2025-06-28\n\nReasoning: {}\n\n# Valid channels: analysis, commentary, final. Channel must be included for every message.<|end|>"
HARMONY_CHANNELS = ("analysis", "commentary", "final")


def render_harmony(messages: Column, effort: str = "low") -> Column:
    """Channel rendering. A system or effort message replaces all text before it; without one
    in front the text begins with ``effort``'s."""
    head, tail = HARMONY_SYSTEM.split("{}")

    def step(text: Column, m: Column) -> Column:
        content, role = m["content"], m["role"]
        out = F.when(role == "system", F.concat(F.lit("<|start|>system<|message|>"), content, F.lit("<|end|>")))
        out = out.when(role == "assistant_reasoning_effort", F.concat(F.lit(head), F.lower(content), F.lit(tail)))
        out = out.when(role == "user", F.concat(text, F.lit("<|start|>user<|message|>"), content, F.lit("<|end|>")))
        for c in HARMONY_CHANNELS:
            out = out.when(role == f"assistant_{c}", F.concat(text, F.lit(f"<|start|>assistant<|channel|>{c}<|message|>"), content, F.lit("<|end|>")))
        return out.otherwise(F.raise_error(F.concat(F.lit("Unknown role: "), role)).cast("string"))

    return F.aggregate(messages, F.lit(head + effort + tail), step)


def span_pattern(t: Template) -> str:
    """The regular expression whose first group is an assistant's supervised text."""
    if t.parser == "openai-harmony":
        return r"<\|start\|>assistant([\s\S]*?)(?=<\|start\|>user<\|message\|>|$)"
    stops = {"longcat": [re.escape("[Round ") + r"\d+" + re.escape("] USER:")], "inkling": [re.escape(x) for x in ("<|message_user|>", "<|message_tool|>", "<|message_system|>")]}.get(t.spans)
    if stops is None:
        stops = [re.escape(t.end)] if t.end else []
    lead = r"(?:</think>)?" if t.spans == "glm" else ""
    return re.escape(t.assistant or "") + lead + r"([\s\S]*?(?:" + "|".join([*stops, "$"]) + "))"


def spans(text: str, t: Template, last_only: bool = False) -> list[tuple[int, int]]:
    """Places of the supervised characters, before ignored tokens are taken out."""
    found = [m.span(1) for m in re.finditer(span_pattern(t), text, re.DOTALL)]
    return found[-1:] if last_only else found


#: A text's ids and the places of each, as lists or arrays.
Tokenize = Callable[[str], tuple[Sequence[int], Sequence[tuple[int, int]]]]
#: Tokens after which a piece of labels is handed on: an Arrow batch has thousands of texts, and
#: their labels together are many times its size.
PIECE = 1 << 20
#: Behind all places.
_END = 1 << 62


def code_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A tokenizer of one id per character, for tests and character counts."""
    ids = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    at = np.arange(len(ids))
    return ids, np.stack([at, at + 1], axis=1)


def _next(found: list[tuple[int, int]], far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the first of ``found`` that ends behind each place of ``far``, which doesn't
    fall; ``_END`` where there is none."""
    x = np.array([*found, (_END, _END)], dtype=np.int64)
    at = np.searchsorted(np.maximum.accumulate(x[:, 1]), far, side="right")
    return x[at, 0], x[at, 1]


def _label(text: str, t: Template, tokenize: Tokenize, max_length: int | None, last_only: bool) -> tuple[np.ndarray, np.ndarray]:
    ids, places = tokenize(text)
    ids = np.asarray(ids[:max_length], dtype=np.int32)
    s, e = np.asarray(places[:max_length], dtype=np.int64).reshape(-1, 2).T
    far = np.maximum.accumulate(s)  # what ends before a token is passed for all tokens after it
    start, end = _next(spans(text, t, last_only), far)
    mask = start <= s
    if t.parser == "openai-harmony":
        mask &= e <= end
    if ignored := sorted(m.span() for token in t.ignored for m in re.finditer(re.escape(token), text)):
        start, end = _next(ignored, far)
        mask &= (s < start) | (s >= end)
    return ids, mask.astype(np.int32)


def label(text: str, t: Template, tokenize: Tokenize = code_points, max_length: int | None = None, last_only: bool = False) -> tuple[list[int], list[int]]:
    """Token ids and their mask: 1 where a token begins in a supervised span and in no ignored
    token (whole tokens inside the span for channel templates)."""
    ids, mask = _label(text, t, tokenize, max_length, last_only)
    return ids.tolist(), mask.tolist()


def _label_pieces(batches: Iterator[pa.RecordBatch], t: Template, tokenize: Tokenize, max_length: int | None, last_only: bool) -> Iterator[pa.RecordBatch]:
    """Batches of key and text to labels, in pieces of ``PIECE`` tokens and one text more at most."""
    for b in batches:
        key, texts = b.columns
        done, held, n = 0, [], 0
        for i in range(len(texts)):
            held.append(_label(texts[i].as_py() or "", t, tokenize, max_length, last_only))
            n += len(held[-1][0])
            if n >= PIECE or i + 1 == len(texts):
                ends = pa.array(np.cumsum([0, *(len(x) for x, _ in held)]), pa.int32())
                parts = [np.concatenate(x) for x in zip(*held, strict=True)] + [np.ones(n, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([key.slice(done, len(held)), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in parts)], names=[b.schema.names[0], "input_ids", "loss_mask", "attention_mask"])
                done, held, n = i + 1, [], 0


def label_texts(rows: DataFrame, template: str | Template, text: str = "text", key: str = "id", tokenize: Tokenize = code_points, max_length: int | None = None, last_only: bool = False) -> DataFrame:
    """``key, input_ids, loss_mask, attention_mask`` of rendered texts, in Arrow batches: regex
    places aren't to be had from built-in functions."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(lambda b: _label_pieces(b, t, tokenize, max_length, last_only), f"{key} {kind}, input_ids array<int>, loss_mask array<int>, attention_mask array<int>")


def label_rendered(rows: DataFrame, template: Template, messages: str = "conversations", key: str = "id", last_only: bool = False) -> DataFrame:
    """The same labels with built-in functions only, one id per character, for conversations
    rendered here: the supervised text is each assistant's content with its terminator."""
    m = F.col(messages)
    parts = F.transform(m, lambda x, i: F.struct(
        F.when(x["role"] == "system", x["content"]).when(x["role"] == "user", F.concat(F.lit(template.user or ""), x["content"])).when(x["role"] == "assistant", F.lit(template.assistant or "")).otherwise(F.lit("")).alias("plain"),
        F.when(x["role"] == "assistant", F.concat(x["content"], F.lit(template.end or ""))).otherwise(F.lit("")).alias("taught"),
        i.alias("i"),
    ))
    last = F.aggregate(parts, F.lit(-1), lambda a, p: F.when(p["taught"] != "", p["i"]).otherwise(a))
    on = (lambda p: F.when(p["i"] == last, 1).otherwise(0)) if last_only else (lambda p: F.lit(1))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["plain"], p["taught"])), "")
    mask = F.flatten(F.transform(parts, lambda p: F.concat(F.array_repeat(F.lit(0), F.length(p["plain"])), F.array_repeat(on(p), F.length(p["taught"])))))
    return rows.select(key, text.alias("text"), mask.alias("loss_mask"))
