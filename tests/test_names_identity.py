import os
import struct

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.operators import identity as I
from plumbline.sources import files

IRREGULAR = [
    ("B1MOLINKER55F140820171104.wav", "B", 1, "MOLINKER", 55, "F", "140820171104"),
    ("VU2MOLINKER55F140820171112.wav", "VU", 2, "MOLINKER", 55, "F", "140820171112"),
    ("FB1sabdel_o40M0909161807.wav", "FB", 1, "sabdel_o", 40, "M", "0909161807"),
    ("B1DRENT UV47M020820171314.wav", "B", 1, "DRENT UV", 47, "M", "020820171314"),
    ("PR1KORPIXAN94M030920171015..wav", "PR", 1, "KORPIXAN", 94, "M", "030920171015"),
    ("PR11KORPIXAN94M030920171057.wav", "PR", 11, "KORPIXAN", 94, "M", "030920171057"),
]
GROUPS = {
    "17 Patients' first visits": "PD",
    "12 Older Comparison": "eHC",
    "9 Younger Comparison": "yHC",
}


def decoded(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    parsed, rejected = I.parse_names(df)
    return {r["name"]: r for r in parsed.collect()}, [r["name"] for r in rejected.collect()]


def test_irregular_names(spark):
    rows, rejected = decoded(spark, [x[0] for x in IRREGULAR] + ["not-a-corpus-file.wav"])
    assert rejected == ["not-a-corpus-file.wav"]
    for name, base, rep, code, year, sex, stamp in IRREGULAR:
        r = rows[name]
        assert (r["task_base"], r["task_rep"], r["code"], r["birth_year_raw"], r["sex"], r["session_stamp"]) == (base, rep, code, year, sex, stamp)


def test_signature_and_session(spark):
    rows, _ = decoded(spark, [
        "B1tannoker49M2104161841.wav", "B1KTORANEN49M110920171859.wav", "B1DEMIKROL46M110920171920.wav",
        "B1DEMIKRUL47M020820171328.wav", "B1demikrol46M0909161659.wav", "B2demikrol46M0909161701.wav",
    ])
    r = list(rows.values())
    assert r[0]["code_signature"] == r[1]["code_signature"]
    assert r[2]["code_signature"] != r[3]["code_signature"]
    assert r[4]["session_date"] == r[5]["session_date"] == "090916"
    assert r[4]["recording_year"] == 2016 and r[2]["recording_year"] == 2017


def test_second_corpus(spark):
    df = spark.createDataFrame([(n,) for n in ("ID02_pd_1_2_1.wav", "ID31_hc_0_1_1.wav", "ID22hc_0_0_0.wav", "invalid_filename.wav")], "name string")
    r = {x["name"]: x for x in N.decode_second(df, "name").collect()}
    a, b = r["ID02_pd_1_2_1.wav"], r["ID31_hc_0_1_1.wav"]
    assert (a["subject_id"], a["group"], a["label"], a["severity_hy"], a["severity_u2"], a["severity_u3"]) == ("KCL_ID02", "PD", 1, 1.0, 2.0, 1.0)
    assert (b["subject_id"], b["group"], b["label"], b["severity_u2"]) == ("KCL_ID31", "HC", 0, 1.0)
    assert r["ID22hc_0_0_0.wav"]["subject_id"] == "KCL_ID22"
    assert not r["invalid_filename.wav"]["matched"] and r["invalid_filename.wav"]["label"] is None


def test_chronological_session_index(spark):
    df = spark.createDataFrame([("a", "230117"), ("a", "05062016"), ("a", "230117")], "subject string, session string")
    text = {r["session"]: r["session_index"] for r in I.session_index(df, "subject", "session").collect()}
    time = {r["session"]: r["session_index"] for r in I.session_index(df, "subject", "session", True).collect()}
    assert text == {"05062016": 1, "230117": 2} == time
    late = spark.createDataFrame([("a", "05062017"), ("a", "230116")], "subject string, session string")
    assert {r["session"]: r["session_index"] for r in I.session_index(late, "subject", "session", True).collect()} == {"230116": 1, "05062017": 2}


@pytest.fixture
def corpus(tmp_path):
    layout = {
        "17 Patients' first visits/1-5/Berta H": [f"{t}HUNDERAK52F020820171041.wav" for t in ("B1", "B2", "D1", "VA1")] + ["VI2HUNDERAK63F020820171052.WAV"],
        "12 Older Comparison/NILO C": [f"{t}SIMARTEN49M150620171029.wav" for t in ("B1", "B2")],
        "12 Older Comparison/NILO D": [f"{t}SIMATREN55M220620171237.wav" for t in ("B1", "B2")],
        "9 Younger Comparison/Nobody B": ["B1AAAAAAAA94M030920171015.wav"],
    }
    for folder, names in layout.items():
        (tmp_path / folder).mkdir(parents=True)
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    (tmp_path / "12 Older Comparison" / "notes.txt").write_text("x")
    return tmp_path


def built(spark, root):
    listing = files.list_files(spark, str(root), list(GROUPS))
    rel = listing.select(F.expr(f"substring(replace(path, '%20', ' '), instr(path, '{os.path.basename(root)}'), 1000)").alias("path"))
    return I.build_metadata(rel, 1, GROUPS, "PD")


def test_metadata_from_files(spark, corpus):
    meta = built(spark, corpus).toPandas()
    assert len(meta) == 10
    assert meta[meta.group == "PD"].subject_id.nunique() == 1
    assert meta.birth_year_typo.sum() == 1
    assert meta[meta.group == "PD"].age.nunique() == 1
    assert meta[meta.group == "eHC"].subject_id.nunique() == 2


def test_privacy(spark, corpus):
    meta = built(spark, corpus)
    safe, plain = I.anonymise(meta).toPandas(), meta.toPandas()
    text = " ".join(safe.folder_path) + " ".join(safe.folder_name)
    for name in ("Berta H", "NILO C", "NILO D", "Nobody B"):
        assert name not in text
    assert safe.folder_path.nunique() == plain.folder_path.nunique()
    assert safe.folder_path.str.startswith("17 Patients").any()
    public = I.redact(meta).columns
    assert not set(public) & set(N.IDENTIFYING) and {"subject_id", "age"} <= set(public)


def test_unparsable_name_stops_the_build(spark, corpus):
    (corpus / "9 Younger Comparison" / "bad.wav").write_bytes(b"x")
    with pytest.raises(ValueError, match="do not match"):
        built(spark, corpus)


def test_missing_folder_and_empty_result(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path), ["nowhere"])
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path))


def wav(rate, channels, bits, frames, extra=b""):
    align = channels * bits // 8
    data = b"\0" * (frames * align)
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * align, align, bits)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_header_profile(spark, tmp_path):
    (tmp_path / "a b's.wav").write_bytes(wav(16000, 1, 16, 8000))
    (tmp_path / "c.WAV").write_bytes(wav(44100, 2, 24, 441, b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    (tmp_path / "far.wav").write_bytes(wav(8000, 1, 8, 80, b"LIST" + struct.pack("<I", 50001) + bytes(50002)))
    (tmp_path / "d.wav").write_bytes(b"nonsense")
    (tmp_path / "short.wav").write_bytes(wav(16000, 1, 16, 0)[:30])
    listing = files.list_files(spark, str(tmp_path))
    rows = {os.path.basename(r["path"]).replace("%20", " "): r for r in files.header_profile(listing, files_per_task=2).collect()}
    a, c, far, d = rows["a b's.wav"], rows["c.WAV"], rows["far.wav"], rows["d.wav"]
    assert (a["samplerate"], a["channels"], a["subtype"], a["duration"]) == (16000, 1, "PCM_16", 0.5)
    assert (c["samplerate"], c["channels"], c["subtype"], c["frames"]) == (44100, 2, "PCM_24", 441)
    assert (far["samplerate"], far["subtype"], far["frames"], far["error"]) == (8000, "PCM_U8", 80, None)
    assert d["samplerate"] is None and "RIFF" in d["error"]
    assert rows["short.wav"]["frames"] is None and rows["short.wav"]["error"]


def test_only_the_beginning_of_a_file_is_read():
    content, asked = wav(16000, 1, 16, 500_000), []

    def read(at, n):
        asked.append((at, n))
        return content[at:at + n]

    assert files.wav_header(read)[3] == 500_000
    assert sum(n for _, n in asked) <= files.HEAD_BYTES
