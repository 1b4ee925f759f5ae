"""Plain sequential statements of the rules, to hold the Spark operators against."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

BOS, EOS = 1, 2


def encode(text: str, specials: bool = True) -> list[int]:
    ids, i = ([BOS] if specials else []), 0
    while i < len(text):
        if text.startswith("</s>", i):
            ids.append(2)
            i += 4
        elif text.startswith("<s>", i):
            ids.append(1)
            i += 3
        else:
            ids.append(ord(text[i]) + 3)
            i += 1
    return ids


def render(messages) -> str:
    out = ""
    for role, content in messages:
        out += f"<|{role}|>\n" + content.strip() + ("</s>" if role == "assistant" else "") + "\n"
    return out


def chat_labels(messages, limit: int, enc=encode):
    """Each token belongs to a message; it is learned in an answer, but not in the header of one that follows another role."""
    ids = enc(render(messages).strip())[:limit]
    starts = [len(enc(render(messages[:i]))) if i else 0 for i in range(len(messages))]
    bodies = [len(enc(render(messages[:i]) + "<|assistant|>\n")) for i in range(len(messages))]

    def learned(place: int) -> bool:
        owner = bisect_right(starts, place) - 1
        follows_other = owner > 0 and messages[owner - 1][0] != "assistant"
        return messages[owner][0] == "assistant" and (place >= bodies[owner] or not follows_other)

    return ids, [token if learned(place) else -100 for place, token in enumerate(ids)]


def buffers(lengths: list[int], limit: float) -> list[int]:
    out, filled, number = [], 0, 0
    for n in lengths:
        if filled >= limit:
            filled, number = 0, number + 1
        filled += n
        out.append(number)
    return out


def chunks(texts: list[str], seq_len: int, limit: float, enc=encode, end: int = EOS):
    ids: dict[int, list[int]] = {}
    for text, b in zip(texts, buffers([len(t) for t in texts], limit)):
        ids.setdefault(b, []).extend(enc(text) + [end])
    return {
        (b, i): tuple(v[i * seq_len : (i + 1) * seq_len]) for b, v in ids.items() for i in range(len(v) // seq_len)
    }


def mixture(rows: list[list], probs: list[float], seed: int, stop: str) -> list[tuple[int, object]]:
    bounds, total = [], 0.0
    for p in probs[:-1]:
        total += p
        bounds.append(format(round(total * 2**32), "08x"))
    bounds.append("g")
    drawn, done, out, step = [0] * len(rows), set(), [], 0
    while True:
        h = hashlib.md5(f"{seed}:{step}".encode()).hexdigest()[:8]
        s = next(i for i, b in enumerate(bounds) if h < b)
        out.append((s, rows[s][drawn[s] % len(rows[s])]))
        drawn[s] += 1
        step += 1
        if drawn[s] == len(rows[s]):
            done.add(s)
            if stop == "first_exhausted" or len(done) == len(rows):
                return out
