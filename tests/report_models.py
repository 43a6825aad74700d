"""Stand-ins for the models of the report tests; imported by name, as the command line does."""

import json


def load(path):
    def decode(prompts):
        out = []
        for p in prompts:
            if "Return exactly one JSON object" in p:
                good = "bad" not in path
                out.append(json.dumps({"answerability": "answerable", "evidence": [{"quote": "Ann Berg built it"}], "rationale": "It is said.", "answer": "Ann Berg", "confidence": "high" if "9" in path else "low"}) if good else "junk")
            else:
                out.append("<think>so</think>\nAnn Berg")
        return out

    return decode


def extract(prompt, seed):
    return json.dumps({"short_answer": "Ann Berg", "refusal_detected": False, "refusal_reason": ""})


def nll(path):
    return lambda prompts, completions: [(float(len(c)), len(c.split())) for c in completions]
