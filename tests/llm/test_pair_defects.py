import pandas as pd
import pytest

from codexloom.llm import pair_defects as pd_

N = ["Arun", "Belor", "Cador", "Dimor", "Elvan", "Feros", "Galen", "Horin"]


def sound(n=260):
    out = []
    for i in range(n):
        x, y, m, s = N[i % 8], N[(i * 3 + 1) % 8], f"${i + 3},{100 + i},000", f"Section {i % 9 + 1}.0{i % 7 + 1}"
        out += [
            (f"Who may release {m} to {x} under {s} of the {y} agreement?", f"{s} lets the Agent release {m} to {x}. The consent of {y} is not needed before then."),
            (f"When did the {x} Facility fall due, and how much of {m} belongs to {y}?", f"The {x} Facility fell due in 2019. {y} cannot claim more than {m}, and I cannot find a later change."),
            (f"Welche Frist gilt nach Ziffer {i % 9}.01 für {x}, wenn noch {m} geschuldet wird?", f"Nach Ziffer {i % 9}.01 gilt eine Frist von {i % 20} Tagen; danach entfällt der Anspruch auf {m}."),
        ]
    return out


FOREIGN = [("fr", "Les garants sont tenus solidairement à hauteur de la somme convenue."), ("es", "Los garantes responden hasta el monto que fija la cláusula."), ("de", "Die Bürgen haften bis zu dem Betrag, der in der Urkunde steht.")] * 5


@pytest.fixture(scope="module")
def model():
    mini = pd.read_parquet("/root/testdata/sf0.1/mini_eval_set.parquet", columns=["text", "gold_answer"]).dropna().drop_duplicates()
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["lang", "text"]).dropna().head(800)
    return pd_.fit(sound(60) + list(mini.itertuples(index=False, name=None)), FOREIGN + list(zip(docs["lang"].str.lower().str.strip(), docs["text"])))


def test_held_out_accuracy(model):
    assert min(model.held_out.values()) > 0.9


Q = "Who may release $7,100,000 to Arun under Section 3.02 of the Belor agreement?"


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), ("  \n", "empty"), ("n/a", "empty"), ("-", "empty"),
        ("Section 3.02 lets the Agent release $7,100,000 to Arun. The consent of", "truncated"),
        ("I'm sorry, but I must decline to comment on Belor.", "refusal"), ("Unfortunately, I cannot help with this request.", "refusal"),
        (Q, "copy"), (Q.lower(), "copy"), (f'"{Q}"', "copy"),
        ("Die Bürgen haften bis zu dem Betrag, der in der Urkunde steht.", "language"), ("Los garantes responden hasta el monto que fija la cláusula.", "language"),
        ("Section 3.02 lets the Agent release $7,100,000 to Arun. The consent of Belor is not needed before then.", None),
        ("$7,100,000", None), ("Section 3.02", None), ("No.", None), ("None of them.", None),
    ],
)
def test_cases(model, answer, defect):
    assert model.defect(Q, answer) == defect


@pytest.mark.parametrize(
    "answer, defect",
    [
        # Written apart from the parts that training uses.
        ("That topic is off limits for me.", "refusal"), ("Nope, not going to touch that one.", "refusal"), ("I'd better leave this to the lawyers, so I won't say.", "refusal"), ("This is something I am not going to get into.", "refusal"),
        ("Pending", "empty"), ("no answer available", "empty"),
        ("Агент может выплатить эту сумму после уведомления заемщика.", "language"), ("De agent mag dit bedrag uitbetalen nadat de kredietnemer daarvan in kennis is gesteld.", "language"), ("代理人可以在通知借款人之后支付该款项。", "language"), ("Agenten får betala ut beloppet efter att låntagaren har underrättats.", "language"),
        ("The Borrower cannot pay Arun before 2020.", None), ("I cannot find any later change, so Section 3.02 governs.", None), ("Sorry for the earlier error: Section 3.02 sets $7,100,000.", None), ("No, the German letter calls it “Rücklage Belor”, but the English text governs.", None),
    ],
)
def test_unseen_answers(model, answer, defect):
    assert model.defect(Q, answer) == defect


@pytest.mark.parametrize("answer", ["Die Mehrheitskreditgeber müssen zustimmen, und Arun hat Belor vorher zu unterrichten.", "Nach Ziffer 3.02 gilt eine Frist von 10 Tagen."])
def test_sound_answers_in_another_language_than_english(model, answer):
    assert model.defect("Wer muss zustimmen, bevor Arun die Tranche über $7,100,000 nach Ziffer 3.02 auf Belor übertragen darf?", answer) is None


def test_the_model_is_the_same_whatever_the_partitions(spark):
    rows = spark.createDataFrame(sound(60), "question string, answer string")
    foreign = spark.createDataFrame(FOREIGN, "lang string, text string")
    a, b = pd_.fit_model(rows, foreign), pd_.fit_model(rows.repartition(7).unionByName(rows), foreign.repartition(3))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
    assert pd_.fit_model(rows.limit(0), foreign.limit(0)).defect("What?", None) == "empty"


def test_rows_nulls_repeats_and_extra_columns(spark, model):
    rows = [("t", "1", Q, None, "x"), ("t", "1", Q, None, "x"), ("t", "2", None, "Section 3.02", "x"), ("t", "3", Q, "word " * 40_000 + "end.", None)]
    df = spark.createDataFrame(rows, "table_name string, record_key string, question string, answer string, defect string")
    got = {(r.record_key, r.defect) for r in pd_.find_defects(df, model, ["table_name", "record_key"]).collect()}
    assert ("1", "empty") in got and not any(k == "2" for k, _ in got)
    assert pd_.find_defects(df.limit(0), model, ["table_name", "record_key"]).count() == 0
