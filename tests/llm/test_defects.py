import json
import random

from tessera.llm import defects as d

CHAT = ["i bought the kettle on monday and it broke", "we have to travel with my brother from there", "never told anyone but i want to rest near the sea", "what would you do if they sold your old guitar?"]
PROMPT = "## ROLE\nYou judge a chat.\n\n## OLD ROLLING SUMMARY\nThe user had a long day at the office and went home.\n\n## INCREMENTAL CHAT RECORDS\n会话：A - B\n" + "".join(f"[2026-01-0{k + 1} 10:00:00] {'AB'[k % 2]}: {m}\n" for k, m in enumerate(CHAT))
SUMMARY = "The user talked about work and a trip. The persona asked about the family and the mood was calm."


def _wire(answer, dialect=0, **more):
    return json.dumps([{"choices": [{"message": {"content": answer}, **more}]}, {"candidates": [{"content": {"parts": [{"text": answer}]}}]}, {"content": [{"type": "text", "text": answer}]}][dialect])


def _output(summary=SUMMARY, **more):
    return json.dumps({"analysis_summary": {"overall_impression": "Calm."}, "user_intent": {"primary_intent": "CASUAL"}, "rolling_summary": summary, "memory_snapshot": {"facts": ["User has a kettle."], "preferences": []}} | more, ensure_ascii=False)


def cases(rng):
    """(response, defect) pairs of every kind."""
    fine = [_wire(_output(), 0), _wire("```json\n" + _output() + "\n```", 1), _wire("Here it is:\n" + _output() + "\nDone.", 2), _wire(_output(SUMMARY + f' "{CHAT[0]}"')), _wire(_output(SUMMARY + " The persona said “sorry, I can't help” and the user laughed.")), _wire(_output(), finish_reason="length")]
    empty = [None, "", "{}", '{"error": "x"}', _wire(""), _wire(" \n​"), _wire("``` ```"), _wire("```json\n{}\n```", 2), _wire("null"), _wire("[]", 1), _wire('""'), _wire(None)]
    cut = [_wire(_output()[:-40]), _wire(_output())[:-60], _wire(_output("The user talked about work and a tr")), _wire("```json\n" + _output()[: len(_output()) // 2]), _wire(_output()[:-30] + " [cut]"), _wire(_output("The user talked about the weather and…"))]
    refusal = [_wire("I'm sorry, but I can't help with this."), _wire("Please bring a different task; this one stays closed."), _wire(_output("I cannot assess private messages.", memory_snapshot={"facts": []})), _wire('{"error": "I must decline to rate this chat."}'), _wire("抱歉，我无法分析这些内容。"), _wire("Lo siento, no puedo ayudar con esto.", 1), _wire("Leider kann ich dabei nicht helfen.", 2), _wire("Je ne peux pas traiter cette demande.")]
    echo = [_wire(PROMPT), _wire(_output(" ".join(f"{'AB'[k % 2]}: {m}" for k, m in enumerate(CHAT)))), _wire("\n".join(CHAT)), _wire(_output(" ".join(CHAT).upper() + "."))]
    other = [_wire(_output("El usuario habló de el trabajo y de un viaje. El personaje preguntó por la familia y el día.")), _wire(_output("用户谈到了工作和旅行。人设回应温和，并询问了家人的近况。")), _wire(_output("Die Person sprach über die Arbeit und eine Reise. Die Figur fragte nach der Familie.")), _wire(_output("La personne a parlé du travail et d'un voyage. Le personnage a demandé des nouvelles de la famille."))]
    rows = [(r, "") for r in fine for _ in range(60)]
    for name, group in zip(d.DEFECTS, (empty, cut, refusal, echo, other)):
        rows += [(r, name) for r in group for _ in range(3)]
    rng.shuffle(rows)
    return rows


def test_cutoffs_hold_on_labelled_pairs(spark):
    rows = cases(random.Random(1))
    df = spark.createDataFrame([(k, PROMPT, r, 0) for k, (r, _) in enumerate(rows)], "id long, prompt string, response string, empty int")
    got = {r.key: [x.defect for x in r.defects] for r in d.labelled(df, "id", "prompt", "response").collect()}
    wrong = {(rows[k][0] or "")[:90] + " | " + rows[k][1]: v for k, v in got.items() if (v[0] if v else "") != rows[k][1]}
    assert not wrong


def test_model_learns_rates():
    rng = random.Random(2)
    truth, counts = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.05
        v = sum((rng.random() < ((0.9, 0.8, 0.7, 0.6)[k] if y else 0.02)) << k for k in range(4))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, [0, 0])[y] += 1
    p = d.fit(counts, 4)
    assert sum(abs(p[v] - t[1] / sum(t)) * sum(t) for v, t in truth.items()) / 20_000 < 0.01
    assert d.fit({}, 4) == {} and d.fit({0: 50}, 4)[0] < 0.01


def test_language_and_odd_pairs(spark):
    assert d.language("the user is at home and not here")[0] == "en" and d.language("la persona no está en la casa")[0] == "es" and d.language("他们在家里")[0] == "zh" and d.language("")[0] is None
    rows = [(1, None, _wire("x")), (2, " \n", None), (3, PROMPT, None), (3, PROMPT, None), (None, PROMPT, _wire(_output())), (4, "p" * 300_000, _wire("y" * 300_000)), (5, PROMPT, _wire('{"a": ' * 5000))]
    df = spark.createDataFrame(rows, "id long, prompt string, response string")
    got = d.labelled(df, "id", "prompt", "response").collect()
    assert sorted(r.key or 0 for r in got) == [0, 3, 3, 4, 5]
    assert d.labelled(df.limit(0), "id", "prompt", "response").count() == 0


def test_padded_empty_answers(spark):
    padded = ["```json\n{}\n```" + " " * 80, "\n" * 70 + "null", "\u3164" * 64, "{" + " " * 64 + "}", "\u200b" * 70 + "```json\nnull\n```", "```\n" + "\n" * 70 + "```"]
    rows = [_wire(_output()) for _ in range(100)] + [_wire(x) for x in padded for _ in range(3)]
    df = spark.createDataFrame([(k, PROMPT, r) for k, r in enumerate(rows)], "id long, prompt string, response string")
    got = {r.key: [x.defect for x in r.defects] for r in d.labelled(df, "id", "prompt", "response").collect()}
    assert all(got[k] == ([] if k < 100 else ["empty"]) for k in got), got


def _voters(prompt, response):
    """Names of the functions that vote, by defect."""
    return {name: {f.__name__ for k, f in enumerate(d.FUNCTIONS[name]) if v >> k & 1} for name, v in zip(d.DEFECTS, d.votes(prompt, response))}


def test_functions_vote_on_echoes():
    lines = "\n".join(CHAT)
    whole, short = _voters(PROMPT, _wire(lines)), _voters(PROMPT, _wire(lines[:-13]))
    assert len(whole["echo"]) >= 3 and not whole["truncated"] and "declines" not in whole["refusal"] and "tells_nothing" not in whole["refusal"]
    assert len(short["echo"]) >= 2 and {"no_end", "inside"} <= short["truncated"]
    both = _voters(PROMPT, _wire("I cannot help with this. " + lines))
    assert both["echo"] and {"declines", "speaks"} <= both["refusal"]
    unpunctuated = _voters(PROMPT, _wire("\n".join(CHAT[:3])))
    assert unpunctuated["echo"] and not unpunctuated["truncated"]
    half_echoed = "word " * 400 + "\n".join(CHAT)  # no sample of places decides whether an answer is compared: the whole one is
    assert d.shared(half_echoed, PROMPT) < 0.2 < 0.65 < d.shared("\n".join(CHAT) + " and more", PROMPT)


def test_ends_of_any_length():
    for k in (1, 40, 4000):
        assert "no_end" not in _voters(PROMPT, _wire(_output(SUMMARY + '"' * k)))["truncated"]
        assert "no_end" in _voters(PROMPT, _wire(_output(SUMMARY[:-1] + " and then" + " " * k + "…")))["truncated"]
        assert "few_signs" in _voters(PROMPT, _wire("```json\n{}\n" + " " * k + "```"))["empty"]


def _patterns(rows):
    return [(d.votes(PROMPT, r), name) for r, name in rows]


def _without(v, k):
    return v if k is None else ((v >> k + 1) << k) | (v & ((1 << k) - 1))


def _posteriors(fitted, judged, defect, drop=None):
    """(probability, truth) of the judged pairs by a model fitted on the others."""
    i = d.DEFECTS.index(defect)
    counts = {}
    for v, _ in fitted:
        counts[_without(v[i], drop)] = counts.get(_without(v[i], drop), 0) + 1
    for v, _ in judged:  # patterns are known to the model, their number of judged pairs isn't
        counts.setdefault(_without(v[i], drop), 0)
    p = d.fit(counts, len(d.FUNCTIONS[defect]) - (drop is not None))
    return [(p[_without(v[i], drop)], name == defect) for v, name in judged]


def _f1(found, cutoff):
    hit = sum(p >= cutoff and y for p, y in found)
    return 2 * hit / max(1, sum(p >= cutoff for p, _ in found) + sum(y for _, y in found))


def test_cutoffs_on_pairs_the_model_has_not_seen():
    rows = _patterns(cases(random.Random(3)))
    fitted, judged = rows[::2], rows[1::2]
    for defect in d.DEFECTS:
        found = _posteriors(fitted, judged, defect)
        best = max(_f1(found, c / 20) for c in range(1, 20))
        assert _f1(found, d.CUTOFFS[defect]) >= best - 0.01 and best > 0.9, defect


def test_no_function_decides_alone():
    rows = _patterns(cases(random.Random(4)))
    for defect in d.DEFECTS:
        for drop in range(len(d.FUNCTIONS[defect])):
            assert _f1(_posteriors(rows, rows, defect, drop), d.CUTOFFS[defect]) > 0.9, (defect, d.FUNCTIONS[defect][drop].__name__)


def test_several_defects_are_kept(spark):
    chat = "\n".join(CHAT)
    rows = [_wire(_output())] * 60 + [_wire("I'm sorry, but I can't help with this and I wi")] * 3 + [r for r, _ in cases(random.Random(5))] + [_wire(chat[:-13])] * 3
    df = spark.createDataFrame([(k, PROMPT, r) for k, r in enumerate(rows)], "id long, prompt string, response string")
    got = {r.key: [x.defect for x in r.defects] for r in d.labelled(df, "id", "prompt", "response").collect()}
    assert got[61] == ["truncated", "refusal"] and got[len(rows) - 1][0] == "truncated" and "echo" in got[len(rows) - 1]
