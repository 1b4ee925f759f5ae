"""Chat rendering over ``messages array<struct<turn, role, content>>``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lmprep.functions.text import py_strip

# Roles and header format of the chat markup.
ROLES = ("system", "user", "assistant")
HEADER = {role: f"<|{role}|>\n" for role in ROLES}


def valid_role(role: Column) -> Column:
    return F.coalesce(role.isin(*ROLES), F.lit(False))


def message_header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def message_body(role: Column, content: Column, eos: str) -> Column:
    ending = F.when(role == "assistant", F.lit(eos + "\n")).otherwise(F.lit("\n"))
    return F.concat(py_strip(content), ending)


def render_message(role: Column, content: Column, eos: str) -> Column:
    """One message as text; a role or content that cannot be rendered fails the query."""
    usable = valid_role(role) & content.isNotNull()
    shown = F.coalesce(role, F.lit("null"))
    return F.when(usable, F.concat(message_header(role), message_body(role, content, eos))).otherwise(
        F.raise_error(F.concat(F.lit("Invalid role or empty content for role: "), shown)).cast("string")
    )


def render_messages(messages: Column, eos: str) -> Column:
    return F.transform(messages, lambda m: render_message(m["role"], m["content"], eos))


def render_chat(messages: Column, eos: str = "</s>") -> Column:
    return F.array_join(render_messages(messages, eos), "")


def chat_training_text(messages: Column, eos: str = "</s>") -> Column:
    return py_strip(render_chat(messages, eos))


def chat_generation_prompt(messages: Column, eos: str = "</s>") -> Column:
    return F.concat(render_chat(messages, eos), F.lit(HEADER["assistant"]))


def chat_prefixes(messages: Column, eos: str = "</s>") -> Column:
    """Every prefix of a conversation.

    Element ``i`` holds ``length`` (messages in the prefix), ``text``, and ``text_to_answer``:
    the same text plus the assistant header when the next message is the assistant's.
    """

    def prefix(i: Column) -> Column:
        text = render_chat(F.slice(messages, F.lit(1), i), eos)
        upcoming = F.get(messages, i)["role"]
        opened = F.when(upcoming == "assistant", F.concat(text, F.lit(HEADER["assistant"]))).otherwise(text)
        return F.struct(i.alias("length"), text.alias("text"), opened.alias("text_to_answer"))

    return F.transform(
        F.when(F.size(messages) > 0, F.sequence(F.lit(1), F.size(messages))).otherwise(
            F.array().cast("array<int>")
        ),
        prefix,
    )


@dataclass(frozen=True)
class ChatTemplate:
    """A tokenizer's chat layout, reduced to data: text around each role and a final cue."""

    prefix: dict[str, str]
    suffix: dict[str, str]
    generation_prompt: str
    begin: str = ""
    strip: bool = True


# Publicly documented chat layouts.
CHAT_TEMPLATES = {
    "headers": ChatTemplate(
        prefix=dict(HEADER),
        suffix={"system": "\n", "user": "\n", "assistant": "</s>\n"},
        generation_prompt=HEADER["assistant"],
    ),
    "chatml": ChatTemplate(
        prefix={role: f"<|im_start|>{role}\n" for role in ROLES},
        suffix={role: "<|im_end|>\n" for role in ROLES},
        generation_prompt="<|im_start|>assistant\n",
        strip=False,
    ),
}


def apply_chat_template(messages: Column, template: ChatTemplate) -> Column:
    """Render messages with a layout and add its generation prompt."""

    def piece(m: Column) -> Column:
        content = py_strip(m["content"]) if template.strip else m["content"]
        text = F.raise_error(F.concat(F.lit("No layout for role: "), m["role"])).cast("string")
        for role in template.prefix:
            wrapped = F.concat(F.lit(template.prefix[role]), content, F.lit(template.suffix[role]))
            text = F.when(m["role"] == role, wrapped).otherwise(text)
        return text

    body = F.array_join(F.transform(messages, piece), "")
    return F.concat(F.lit(template.begin), body, F.lit(template.generation_prompt))
