import json
import os

import pytest

from stylograph.sources import archive, voice

RECORDS = [
    {"tweet": {"id_str": "1", "full_text": "original = text; here", "created_at": "Mon Jan 01 00:00:00 +0000 2026"}},
    {"tweet": {"id_str": "2", "full_text": "@someone the reply", "in_reply_to_status_id_str": "1"}},
    {"id": "3", "text": "RT @x: shared"},
    {"id": 4, "text": "quoted", "retweeted_status": {"id": 9}},
    {"id": "5", "text": "kept", "retweeted_status": {}},
    {"tweet": {"id_str": "6", "full_text": "@only @mentions", "text": "other"}},
]


def export(folder, content, place="tweets.js", bom=True):
    path = folder / place
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8-sig" if bom else "utf-8")
    return str(folder)


@pytest.mark.parametrize("place", archive.PLACES)
def test_read(spark, tmp_path, place):
    folder = export(tmp_path, "window.YTD.tweets.part0 = " + json.dumps(RECORDS, indent=1) + " ;\n", place)
    rows = archive.read_archive(spark, folder).orderBy("pos").collect()
    assert [r.id for r in rows] == ["1", "2", "3", "4", "5", "6"]
    assert rows[0].text == "original = text; here" and rows[0].created_at.endswith("2026") and rows[2].created_at == ""
    assert [r.is_reply for r in rows] == [False, True, False, False, False, False]
    assert [r.is_retweet for r in rows] == [False, False, True, True, False, False]
    posts = archive.read_archive(spark, folder)
    assert sorted(r.text for r in archive.own_posts(posts).collect()) == ["kept", "original = text; here"]
    assert sorted(r.id for r in archive.own_posts(posts, include_replies=True).collect()) == ["1", "2", "5"]


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        archive.find_archive_file(str(tmp_path))
    for i, content in enumerate(("[1, 2]", 'x = {"a": 1}', "x = [1, ")):
        with pytest.raises(ValueError):
            archive.read_archive(spark, export(tmp_path / str(i), content))


def test_the_query_reads_every_record_of_the_export(spark):
    from stylograph.plans import queries as Q

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    want = [tuple(r)[1:] for r in Q.normalize_records(spark, folder).orderBy("raw_id").collect()]
    got = Q.load_archive(spark, folder).orderBy("pos").collect()
    assert len(want) > 4 and [r.pos for r in got] == list(range(len(want))) and [tuple(r)[1:] for r in got] == want


def test_voice(tmp_path):
    path = str(tmp_path / "v.json")
    voice.write_voice(path, "guide é", ["a", "b"])
    assert voice.read_voice(path) == {"style_guide": "guide é", "exemplars": ["a", "b"]}
