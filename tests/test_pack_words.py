"""The analysis looks for the words that the rules of its pack name."""

import dataclasses

from mxposture.operators.rules import pack_words
from mxposture.sources.rulepacks import PROFILES, built_in_pack


def test_words_come_from_the_pack():
    for profile in PROFILES:
        pack = built_in_pack(profile)
        paths = {p.path for r in pack.rules for p in (*r.where, *r.check)}
        assert bool(pack_words(pack)) == ("derived.observed_commands" in paths)
    rule = next(r for r in pack.rules if r.where or r.check)
    first = (*rule.where, *rule.check)[0]
    other = dataclasses.replace(first, path="derived.observed_commands", value="auth")
    changed = dataclasses.replace(pack, rules=(dataclasses.replace(rule, where=(other,), check=()),))
    assert pack_words(changed) == ["AUTH"]
