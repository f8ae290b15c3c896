"""The rules of chunking one unit after the other, to hold the tables against."""

import math
import re
import unicodedata

SENTENCE = re.compile(r"(?<=[.。!?다함됨음])\s+")
ITEM = re.compile(r"^[가-하]\s*[.)]\s*\S")
TABLE = ("TABLE_ROW", "TABLE_HEADER")


def estimate(text):
    return max(1, math.floor(len(text) / 1.89 + 0.999)) if text else 0


def groups_of(units):
    """Lists of (unit, heading); a unit is a dict with text, kind, start, table, page, a, b."""
    groups, heading, before = [], None, None
    for u in units:
        listed = bool(ITEM.match(u["text"]))
        title, table = u["kind"] == "HEADING" and not listed, u["kind"] in TABLE
        was = before is not None and before["kind"] in TABLE
        was_in = before["table"] if was else None
        if before is None or title:
            new = True
        elif table:
            new = was_in != u["table"] if was_in is not None else not was
        else:
            new = was_in is not None or u["start"] and not listed
        heading = u["text"] if title else heading
        if new:
            groups.append([])
        groups[-1].append((u, heading))
        before = u
    return groups


def greedy(items, budget):
    """items: (payload, tokens, alone)."""
    out, held = [], None
    for payload, tokens, alone in items:
        if alone or held is None or held + tokens > budget:
            out.append([])
            held = 0
        out[-1].append((payload, alone))
        held = None if alone else held + tokens
    return out


def pieces(text, budget):
    parts = [p for p in SENTENCE.split(text) if p.strip()]
    parts = parts if len(parts) > 1 else text.split()
    items, step = [], max(1, int(budget * 1.89))
    for p in parts:
        if estimate(p) > budget:
            items += [(p[i : i + step], 0, True) for i in range(0, len(p), step)]
        else:
            items.append((p, estimate(p), False))
    return [" ".join(p for p, _ in run) for run in greedy(items, budget)]


def drafts_of(group, most):
    heading, last = group[0][1], group[-1][0]
    header = "\n".join(u["text"] for u, _ in group if u["kind"] == "TABLE_HEADER") if last["kind"] in TABLE and last["table"] is not None else ""
    prefix = heading + "\n" if heading else ""
    for prefix, header in ((prefix, header), ("", header), ("", "")):
        budget = most - estimate(prefix) - (estimate(header + "\n") if header else 0)
        if budget > 0:
            break
    items = []
    for u, _ in group:
        if estimate(u["text"]) > budget:
            items += [({"text": p, "page": u["page"], "a": None, "b": None}, 0, True) for p in pieces(u["text"], budget)]
        else:
            items.append((u, estimate(u["text"]), False))
    out = []
    for j, run in enumerate(greedy(items, budget)):
        body = "\n".join(u["text"] for u, _ in run)
        lead = prefix if j else ""
        if header and j and (run[0][1] or header not in body):
            lead += header + "\n"
        known = lambda c: [u[c] for u, _ in run if u[c] is not None]  # noqa: B023, E731
        out.append({"text": lead + body, "lead": lead, "page": next(iter(known("page")), None), "a": min(known("a"), default=None), "b": max(known("b"), default=None), "heading": heading})
    return out


def merged(drafts, least, most):
    first = lambda x, y: x if x is not None else y
    out, pending = [], None
    for d in drafts:
        if pending:
            text = pending["text"] + "\n" + d["text"]
            if estimate(text) <= most:
                d = {"text": text, "lead": pending["lead"], "page": first(pending["page"], d["page"]), "a": first(pending["a"], d["a"]), "b": first(d["b"], pending["b"]), "heading": pending["heading"] or d["heading"]}
            else:
                out.append(pending)
        pending = d if estimate(d["text"]) < least else None
        if not pending:
            out.append(d)
    if pending:
        if out and estimate(out[-1]["text"] + "\n" + pending["text"]) <= most:
            out[-1] = out[-1] | {"text": out[-1]["text"] + "\n" + pending["text"], "b": first(pending["b"], out[-1]["b"])}
        else:
            out.append(pending)
    return out


def tail_of(text, limit):
    kept, total = [], 0
    for part in reversed([p for p in SENTENCE.split(text) if p.strip()]):
        if kept and total + estimate(part) > limit:
            break
        kept.insert(0, part)
        total += estimate(part)
        if total >= limit:
            break
    tail = " ".join(kept)
    return "" if tail == text.strip() else tail


def chunks(units, most=480, least=30, overlap=48):
    """text, page, a, b, heading of each chunk."""
    kept = [u | {"text": unicodedata.normalize("NFC", u["text"]).strip()} for u in units if u["kind"] != "HEADER_FOOTER" and u["text"].strip()]
    drafts = merged([d for g in groups_of(kept) for d in drafts_of(g, most)], least, most)
    out = []
    for before, d in zip([None, *drafts], drafts):
        text = d["text"]
        tail = tail_of(before["text"], overlap) if before and overlap else ""
        if tail:
            lead = ""
            if d["lead"] and text.startswith(d["lead"]):
                lead = d["lead"]
            elif d["heading"] and text.split("\n")[0].strip() == d["heading"].strip():
                lead = text[: text.find("\n") + 1] if "\n" in text else text
            longer = lead + tail + "\n" + text[len(lead) :]
            text = longer if estimate(longer) <= most else text
        if text.strip():
            out.append((text.strip(), d["page"], d["a"], d["b"], d["heading"]))
    return out
