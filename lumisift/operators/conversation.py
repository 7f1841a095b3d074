"""Conversation templates, and prompts from messages as column expressions.

Messages are an array of (role, text); a null or empty text is the turn that a model is to fill.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE, TWO = "add_colon_single", "add_colon_two"


@dataclass
class Template:
    """Separator styles other than the two can be registered, but make no prompt."""

    name: str
    system: str = ""
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    image_mark: str = "<image>"
    answer_mark: str = ""
    style: str = TWO
    sep: str = " "
    sep2: str | None = "<|endofchunk|>"
    stop_str: str | None = None
    offset: int = 0
    messages: list[list[str | None]] = field(default_factory=list)

    def copy(self) -> Template:
        return replace(self, messages=[list(m) for m in self.messages])

    def append(self, role: str, text: str | None) -> None:
        self.messages.append([role, text])

    def update_last(self, text: str | None) -> None:
        self.messages[-1][1] = text

    def as_dict(self) -> dict:
        return {"template_name": self.name, "system": self.system, "roles": list(self.roles), "messages": [list(m) for m in self.messages], "offset": self.offset}


_registry: dict[str, Template] = {}


def register(template: Template, override: bool = False) -> None:
    if template.name in _registry and not override:
        raise ValueError(f"{template.name} is registered already")
    _registry[template.name] = template


def get(name: str) -> Template:
    """A copy that can be changed."""
    return _registry[name].copy()


def names() -> list[str]:
    return sorted(_registry)


#: Our own wording for each task.
_TASKS = {
    "event_enriched_caption": "Write a caption that ties what the picture shows to the event in the report.",
    "cot_event_caption": "Work out step by step who, what, where and when, then write the caption.",
    "qa_generation": "Ask and answer questions about the facts that the report gives.",
    "named_entity_extraction": "List the people, places, organisations and dates that are named.",
    "image_retrieval": "Describe the picture so that it can be found again.",
    "detailed_image_description": "Describe everything the picture shows, in detail.",
    "short_image_caption": "Say in one short sentence what the picture shows.",
}
#: Fixed values from here on: names, roles, separators, marks and stop strings of the templates.
_PLAIN = "A user talks with an assistant. The assistant answers helpfully and precisely."
for _name, _system in _TASKS.items():
    register(Template(_name, _system))
register(Template("news_article_analysis", "Read the report and explain what it says.", image_mark=""))
_SHOT = {"roles": ("Human", "Assistant"), "image_mark": "", "style": SINGLE, "sep": "\n### ", "sep2": None, "stop_str": "###"}
register(Template("one_shot", _PLAIN, offset=2, messages=[["Human", "How do I boil an egg?"], ["Assistant", "Put it into boiling water for seven minutes."]], **_SHOT))
register(Template("zero_shot", _PLAIN, **_SHOT))
register(Template("vicuna_v1.1", _PLAIN, image_mark="", sep2="</s>"))
register(Template("open_flamingo_v1.1", _PLAIN, answer_mark="<answer>"))
register(Template("octopus", roles=("USER", "GPT"), answer_mark="<answer>"))
register(Template("drivegpt", roles=("USER", "GPT"), answer_mark="<answer>"))
register(Template("openflamingo", roles=("Question", "Answer")))
register(Template("otter", roles=("User", "GPT"), answer_mark="<answer>"))
register(Template("cleverflamingo", roles=("### Human", "<image>\n### Assistant"), image_mark="", sep=""))


def _marks(t: Template, i: Column) -> tuple[Column, Column]:
    even = i % 2 == 0
    return F.when(even, t.image_mark).otherwise(""), F.when(even, "").otherwise(t.answer_mark)


def _turns(t: Template, messages: Column, filled, empty) -> Column:
    if t.style not in (SINGLE, TWO):
        raise ValueError(f"style {t.style} makes no prompt")
    head = F.lit(t.system + (t.sep if t.style == SINGLE else ""))
    sep = lambda i: F.lit(t.sep) if t.style == SINGLE else F.when(i % 2 == 0, t.sep).otherwise(t.sep2 or "")

    def one(m: Column, i: Column) -> Column:
        image, answer = _marks(t, i)
        said = m["text"].isNotNull() & (m["text"] != "")
        return F.when(said, filled(m, image, answer, sep(i))).otherwise(empty(m, image, answer))

    return F.concat(head, F.array_join(F.transform(messages, one), ""))


def prompt(t: Template, messages: Column) -> Column:
    """Marks before the role; a turn to fill ends with the role's colon."""
    return _turns(t, messages, lambda m, image, answer, sep: F.concat(image, m["role"], F.lit(": "), answer, m["text"], sep), lambda m, image, answer: F.concat(image, m["role"], F.lit(":"), answer))


def interleaved_prompt(t: Template, messages: Column) -> Column:
    """Marks after the role; with two separators filled turns have no role."""
    if t.style == TWO:
        return _turns(t, messages, lambda m, image, answer, sep: F.concat(m["text"], sep), lambda m, image, answer: F.concat(m["role"], F.lit(": "), image, answer))
    return _turns(t, messages, lambda m, image, answer, sep: F.concat(m["role"], F.lit(": "), image, answer, m["text"], sep), lambda m, image, answer: F.concat(m["role"], F.lit(":"), image, answer))


def texts(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["text"]), "")


def api_messages(system: Column, messages: Column, offset: int = 0) -> Column:
    """System, then user and assistant in turn from the offset on; assistant turns without text are left out."""
    own = F.slice(messages, offset + 1, 2_000_000_000)
    each = F.transform(own, lambda m, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), m["text"].alias("content")))
    kept = F.filter(each, lambda m: (m["role"] == "user") | m["content"].isNotNull())
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), kept)


def appended(messages: Column, role: Column, text: Column) -> Column:
    return F.concat(messages, F.array(F.struct(role.alias("role"), text.alias("text"))))


def last_updated(messages: Column, text: Column) -> Column:
    n = F.size(messages)
    return F.when(n > 0, F.concat(F.slice(messages, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(F.element_at(messages, -1)["role"].alias("role"), text.alias("text"))))).otherwise(messages)


def chat_view(messages: Column, offset: int = 0, name: str = "Assistant") -> Column:
    """Pairs of what was said and what was answered, for display: answers lose text before the last role name, and end marks. The role name and both marks are fixed values."""
    own = F.slice(messages, offset + 1, 2_000_000_000)
    said = F.transform(F.filter(own, lambda m, i: i % 2 == 0), lambda m: F.regexp_replace(F.coalesce(m["text"], F.lit("")), "<image>", ""))
    answer = F.transform(F.filter(own, lambda m, i: i % 2 == 1), lambda m: F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(m["text"], r"(?s)^.*GPT:", ""), r"<\|endofchunk\|>", "")))
    return F.transform(said, lambda s, i: F.struct(s.alias("said"), F.get(answer, i).alias("answered")))
