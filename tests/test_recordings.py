"""Recorded transcripts against the view that a reader of the format would write by hand."""

from notewell.operators import recordings


def tool(name, body):
    return f"<details><summary>🔧 {name}</summary>\n{body}\n</details>\n"


TRACE = "\n".join(f"line {k}" for k in range(20))
RAW = (
    "---\na: 1\n---\n# Fix it\r\n\nlost prose\n## ⚙️ System\nframe\n## 👤 User — 2026-01-01 10:00\n"
    "<environment_context>cwd</environment_context>please <command-args>run</command-args>\n\n\n\nnow\n"
    "## 🤖 Assistant · model\n# dropped\n<details><summary>💭 hm</summary>\nsecret\n</details>\n"
    + tool("Bash", f"**Erreur** :\n```\n{TRACE}\n```")
    + tool("Read", "**Résultat** :\n```\nNo such file\n```")
    + tool("Read", "**Résultat** :\nfine")
    + tool("Bash", "**Arguments** :\nERROR\n**Résultat** :\nfine")
    + "done, password: hunter22\n"
)
CUT = "\n  ".join([f"line {k}" for k in range(8)] + ["[… 9 lignes omises …]", "line 17", "line 18", "line 19"])
VIEW = (
    "# Conversation — Fix it\n\n# Résumé des appels d'outils (calculé, non déclaratif)\n\n"
    "- appels : 4 ; en échec : 2 ; reprises réussies après échec : 1\n- outils en échec : Bash ×1, Read ×1\n"
    "- échec Bash — line 0\n- échec Read — No such file\n- dernier appel d'outil : Bash — succès\n\n"
    "## User\n\nplease run\n\nnow\n\n## Assistant\n\ndone, <REDACTED_PASSWORD>\n\n# Technical events relevant to analysis\n\n"
    f"- outil Bash — erreur : {CUT}\n- outil Read — erreur : No such file\n- outil Bash — suite : reprise réussie après l'échec précédent\n"
)


def test_a_recording_is_rendered(spark):
    raws = spark.createDataFrame([("r", RAW, 1), ("none", None, 2), ("plain", "no blocks\n", 3)], "raw_id string, text string, title int")
    made = {r.raw_id: r.markdown for r in recordings.rendered(raws).collect()}
    assert made == {"r": VIEW, "none": "# Conversation\n", "plain": "# Conversation\n"}


def test_long_messages_and_empty_tables(spark):
    raws = spark.createDataFrame([("r", "## 👤 User\n" + "a" * 300_000)], "raw_id string, text string")
    (row,) = recordings.recorded_messages(recordings.blocks(raws)).collect()
    assert row.text == "a" * 6000 + recordings.TRUNCATED
    assert recordings.rendered(raws.where("false")).count() == 0


def test_failures_of_tools(spark):
    bodies = ["**Erreur** :\nx", "**Résultat** :\nexit code 2", "**Résultat** :\nexit code 0", "Exception", "**Résultat** :\n erreur: x"]
    held = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
    assert [r.e for r in held.orderBy("k").select(recordings.is_error(held.body).alias("e")).collect()] == [True, True, False, False, True]
