"""From a question to a query: a plan by rules where every word is known, guards that only remove, and the resolved query.

Runs on the driver: a question is a constant of the DataFrame plans that answer it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from weftline.functions.dates import DayRange, _folded, day_range
from weftline.operators.filters import EventFilter

#: Nouns that name a source, words that name a direction, and words for tasks, images, summaries and everything.
NOUNS = {
    "git": "commit commits", "browser": "pagina paginas site sites pesquisas navegador page pages", "file": "arquivo arquivos file files",
    "teams": "mensagem mensagens conversa conversas chat chats message messages conversation conversations",
}
DIRECTIONS = {"received": "recebi recebidas received", "sent": "enviei mandei enviadas sent"}
TASKS = "tarefa tarefas task tasks ticket tickets card cards demanda demandas issue issues"
PICTURES = "imagem imagens foto fotos print prints captura capturas screenshot screenshots image images photo photos picture pictures"
SUMMARY, EVERYTHING = "resuma resumo resumir summarize summary", "tudo everything timeline"
GENERIC = """
o a os as um uma que quais qual eu meu meus minha minhas de do da dos das em no na nos nas
fiz fizemos trabalhei aconteceu estao ainda ficaram liste listar mostre abri visitei acessei editei alterei
modifiquei modificados modificadas todas todos dia
finalizei finalizadas conclui concluidas terminei entreguei pendentes pendente andamento aberta aberto abertas abertos nao com pr
what which did i do work worked on in the my from of show list me happened are is still all day
finish finished complete completed done closed open pending progress edit edited changed modified visited opened
"""
#: Cues that a question supports a filter, in folded text.
ASKING = r"\b(o que|what)\b"
TASK_CUES = r"\b(tarefas?|tasks?|tickets?|cards?|demandas?|issues?)\b"
DONE, PENDING = r"(finaliz|conclu|termin|entreg|finish|complet|\bdone\b|\bclosed\b)", r"(andamento|pendente|abert|faltando|progress|pending|\bopen\b|unfinished|nao (finaliz|conclu|termin))"
PR_OPENED = r"\b(pr|pull request)\s+(aberto|aberta|opened)\b"
IMAGE_CUES = r"\b(imagem|imagens|fotos?|prints?|capturas?|screenshots?|images?|photos?|pictures?)\b"
OTHERS_CUES = r"\b(quem mais|o que mais|outr[ao]s|who else|what else|others?)\b"
RECEIVED_CUES = r"\b(recebi|recebid[ao]s?|me (passou|passaram|mandou|mandaram|enviou|enviaram|pediu|pediram|falou|falaram|disse|disseram|perguntou)|received|(sent|send|told|tell|asked|ask|gave|give|passed|pass|messaged|message|wrote|write) me)\b"
SENT_CUES = r"\b(mandei|enviei|pedi|falei|perguntei|respondi|i (sent|send|told|tell|asked|ask|messaged|message|replied|reply|wrote|write|answered|answer))\b"
FROM_WORDS, TO_WORDS = "de|da|do|das|dos|from", "para|pra|pro|para a|para o|to"
FIRST_PERSON = r"\b(eu|meu|meus|minha|minhas|fiz|fizemos|trabalhei|i|my|me)\b"


@dataclass(frozen=True)
class Plan:
    """What a question states."""

    mode: str = "answer"
    period: str = ""
    source: str = ""
    people: tuple[str, ...] = ()
    direction: str = "any"
    topic: str = ""
    status: str = ""
    entities: tuple[str, ...] = ()
    modality: str = ""
    related: bool = False
    by_rules: bool = False


@dataclass(frozen=True)
class Query:
    """A plan with its days, text and scope resolved."""

    plan: Plan
    days: DayRange | None
    text: str
    own_commits: bool

    @property
    def scoped(self) -> bool:
        """Whether a filter names what to look at; distance gates are skipped then."""
        p = self.plan
        return bool(self.days or p.source or p.people or p.modality or p.entities)

    def filter(self, zone: str = "UTC") -> EventFilter:
        """The query as a filter of events."""
        start, end = self.days.instants(zone) if self.days else (None, None)
        return EventFilter(start, end, self.plan.source, self.plan.direction, self.plan.people)


def plan_by_rules(question: str, today: date = date(2024, 3, 20)) -> Plan | None:
    """A plan if the rules know every word of the question and it means one thing; None leaves it to a model."""
    text = _folded(question)
    found = day_range(question, today) or day_range(question, today, day_first=False)
    period = found[1] if found else ""
    meaning: dict[str, tuple[str, str]] = {}
    for kind, groups in (("source", NOUNS), ("direction", DIRECTIONS), ("cue", {"tasks": TASKS, "images": PICTURES, "summary": SUMMARY, "everything": EVERYTHING, "": GENERIC})):
        for value, listed in groups.items():
            meaning |= {word: (kind, value) for word in listed.split() if word not in meaning}
    said: dict[str, set[str]] = {"source": set(), "direction": set(), "cue": set()}
    for word in re.findall("[a-z0-9]+", text.replace(period, " ", 1) if period else text):
        if word not in meaning:
            return None
        kind, value = meaning[word]
        said[kind].add(value)
    sources, ways, cues = said["source"], said["direction"], said["cue"]
    items = bool(sources) or "images" in cues
    if len(sources) > 1 or len(ways) > 1 or (ways and sources != {"teams"}) or ("tasks" in cues and items):
        return None
    plan = Plan(period=period, source=next(iter(sources), ""), direction=next(iter(ways), "any"), modality="image" if "images" in cues else "", by_rules=True)
    if "tasks" in cues:
        return replace(plan, mode="tasks", status=status_in(text))
    if "summary" in cues or not (items or "everything" in cues):
        return plan
    return None if re.search(ASKING, text) else replace(plan, mode="list")


def status_in(text: str) -> str:
    """done, in_progress or nothing, as a question's words have it; `not finished` is in progress."""
    if re.search(PR_OPENED, text):
        return "done"
    return "in_progress" if re.search(PENDING, text) else "done" if re.search(DONE, text) else ""


def guarded(plan: Plan, question: str) -> Plan:
    """A plan without what the question doesn't support. Nothing is ever added."""
    text = _folded(question)
    if plan.mode == "tasks" and not re.search(TASK_CUES, text):
        plan = replace(plan, mode="answer")
    if plan.mode != "tasks" or (plan.status and plan.status != status_in(text)):
        plan = replace(plan, status="")
    if not re.search(IMAGE_CUES, text):
        plan = replace(plan, modality="")
    asked = set(re.findall("[a-z0-9]+", text))
    named = tuple(e for e in plan.entities if plan.modality and (w := re.findall("[a-z0-9]+", _folded(e))) and w[0] in asked)
    plan = replace(plan, entities=named)
    if not (re.search(OTHERS_CUES, text) and (plan.people or plan.entities)):
        plan = replace(plan, related=False)
    if plan.direction != "any":
        cues, words = (RECEIVED_CUES, FROM_WORDS) if plan.direction == "received" else (SENT_CUES, TO_WORDS)
        beside = any(re.search(rf"\b({words}) {re.escape(_folded(p).split()[0])}\b", text) for p in plan.people if p.strip())
        if not (re.search(cues, text) or beside):
            plan = replace(plan, direction="any")
    return replace(plan, period="") if plan.period and _folded(plan.period) not in text else plan


def resolved(plan: Plan, question: str, today: date, day_first: bool = True) -> Query:
    """The query of a plan: days, text to search (the topic alone once filters scope it), whose commits, and its mode."""
    found = day_range(plan.period or question, today, day_first)
    days = found[0] if found else None
    if plan.mode == "list" and not days:
        plan = replace(plan, mode="answer")
    if plan.mode == "tasks" and not days:
        days = DayRange(today, today)
    query = Query(plan, days, question, bool(re.search(FIRST_PERSON, _folded(question))) and not plan.people)
    return replace(query, text=plan.topic or question) if query.scoped else query


def plan(question: str, today: date, model: Callable[[str], Plan] | None = None) -> Query:
    """A question's query: by rules, else by the model given (whose failure plans nothing), guarded either way."""
    found = plan_by_rules(question)
    if found is None and model is not None:
        try:
            found = model(question)
        except Exception:  # noqa: BLE001 - a model that fails must not fail the question
            found = None
    return resolved(guarded(found or Plan(), question), question, today)
