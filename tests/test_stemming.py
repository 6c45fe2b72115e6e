import pytest

from siltstone.functions.stemming import stem, stemmed

#: Pairs from the published sample vocabulary.
KNOWN = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistent": "consist", "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol",
    "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid",
    "consoling": "consol", "consolingly": "consol", "consols": "consol", "knack": "knack", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish",
    "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "knees": "knee", "knell": "knell", "knew": "knew",
    "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit",
    "knitting": "knit", "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker", "knots": "knot",
    "happy": "happi", "by": "by", "say": "say", "hopping": "hop", "hoping": "hope", "hoped": "hope", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "skies": "sky", "dying": "dy", "news": "news",
    "generously": "generous", "relational": "relat", "rate": "rate", "ski": "ski",
}


@pytest.mark.parametrize("word", sorted(KNOWN))
def test_known_stems(word):
    assert stem(word) == KNOWN[word]


def test_column(spark):
    frame = spark.createDataFrame([(["knees", "été", "a"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in frame.select(stemmed(frame.t)).collect()] == [["knee", "été", "a"], None, []]
