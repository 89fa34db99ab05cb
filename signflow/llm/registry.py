"""The driver queries of the training-data operators."""

from __future__ import annotations

from signflow.llm import centroids, chat, decontaminate, html, langid, licenses, ngram_join, packing, quality, resample, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_chat": chat.op1_chat,
        "op2_packing": packing.op2_packing,
        "op3_quality": quality.op3_quality,
        "op4_simhash": simhash.op4_simhash,
        "op5_langid": langid.op5_langid,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_licenses": licenses.op7_licenses,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_warc": warc.op9_warc,
        "op10_html": html.op10_html,
        "op11_centroids": centroids.op11_centroids,
        "op12_ngram_join": ngram_join.op12_ngram_join,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict:
    return {
        "op3_quality": quality.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op7_licenses": licenses.ORACLE,
        "op9_warc": warc.ORACLE,
        "op11_centroids": centroids.ORACLE,
        "op12_ngram_join": ngram_join.ORACLE,
        "op13_resample": resample.ORACLE,
    }
