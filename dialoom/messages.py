"""Message catalogue of composed documents, one row per language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.session import small_table

DEFAULT_LANGUAGE = "English"
KEYS = (
    "notebook_description",
    "source_script",
    "syntax_check_results",
    "errors_from_checks",
    "python_syntax_errors",
    "spark_sql_syntax_errors",
    "no_errors_detected",
    "review_code",
)

# The texts, by language, in the order of KEYS.
MESSAGES = {
    "English": (
        "This notebook was automatically converted from the script below. It may contain errors, so use it as a starting point and make necessary corrections.",
        "Source script",
        "Static Syntax Check Results",
        "These are errors from static syntax checks. Manual corrections are required for these errors.",
        "Python Syntax Errors",
        "Spark SQL Syntax Errors",
        "No syntax errors were detected during the static check.",
        "However, please review the code carefully as some issues may only be detected during runtime.",
    ),
    "Japanese": (
        "このノートブックは以下のスクリプトから自動的に変換されました。エラーが含まれている可能性があるため、出発点として使用し、必要な修正を行ってください。",
        "ソーススクリプト",
        "静的構文チェック結果",
        "以下は静的構文チェックの結果です。エラーがある場合、手動での修正が必要です。",
        "Python構文エラー",
        "Spark SQL構文エラー",
        "静的チェック中に構文エラーは検出されませんでした。",
        "ただし、一部の問題は実行時にのみ検出される可能性があるため、コードを注意深く確認してください。",
    ),
    "Chinese": (
        "此笔记本是从以下脚本自动转换而来。它可能包含错误，请将其作为起点并进行必要的修正。",
        "源脚本",
        "静态语法检查结果",
        "这些是静态语法检查中发现的错误。这些错误需要手动修正。",
        "Python语法错误",
        "Spark SQL语法错误",
        "在静态检查中未检测到语法错误。",
        "但是，请仔细检查代码，因为某些问题可能只有在运行时才能检测到。",
    ),
    "French": (
        "Ce notebook a été automatiquement converti à partir du script ci-dessous. Il peut contenir des erreurs, utilisez-le comme point de départ et apportez les corrections nécessaires.",
        "Script source",
        "Résultats de la vérification syntaxique statique",
        "Voici les erreurs détectées lors des vérifications syntaxiques statiques. Des corrections manuelles sont nécessaires pour ces erreurs.",
        "Erreurs de syntaxe Python",
        "Erreurs de syntaxe Spark SQL",
        "Aucune erreur de syntaxe n'a été détectée lors de la vérification statique.",
        "Cependant, veuillez examiner attentivement le code car certains problèmes ne peuvent être détectés que lors de l'exécution.",
    ),
    "German": (
        "Dieses Notebook wurde automatisch aus dem unten stehenden Skript konvertiert. Es kann Fehler enthalten, verwenden Sie es als Ausgangspunkt und nehmen Sie die notwendigen Korrekturen vor.",
        "Quellskript",
        "Ergebnisse der statischen Syntaxprüfung",
        "Dies sind Fehler aus statischen Syntaxprüfungen. Für diese Fehler sind manuelle Korrekturen erforderlich.",
        "Python-Syntaxfehler",
        "Spark SQL-Syntaxfehler",
        "Bei der statischen Prüfung wurden keine Syntaxfehler festgestellt.",
        "Überprüfen Sie den Code jedoch sorgfältig, da einige Probleme möglicherweise erst zur Laufzeit erkannt werden.",
    ),
    "Italian": (
        "Questo notebook è stato convertito automaticamente dallo script sottostante. Potrebbe contenere errori, quindi usalo come punto di partenza e apporta le correzioni necessarie.",
        "Script sorgente",
        "Risultati del controllo sintattico statico",
        "Questi sono errori derivanti dai controlli sintattici statici. Sono necessarie correzioni manuali per questi errori.",
        "Errori di sintassi Python",
        "Errori di sintassi Spark SQL",
        "Non sono stati rilevati errori di sintassi durante il controllo statico.",
        "Tuttavia, si prega di rivedere attentamente il codice poiché alcuni problemi potrebbero essere rilevati solo durante l'esecuzione.",
    ),
    "Korean": (
        "이 노트북은 아래 스크립트에서 자동으로 변환되었습니다. 오류가 포함되어 있을 수 있으므로 시작점으로 사용하고 필요한 수정을 하십시오.",
        "소스 스크립트",
        "정적 구문 검사 결과",
        "이것들은 정적 구문 검사에서 발견된 오류입니다. 이러한 오류에는 수동 수정이 필요합니다.",
        "Python 구문 오류",
        "Spark SQL 구문 오류",
        "정적 검사 중 구문 오류가 감지되지 않았습니다.",
        "그러나 일부 문제는 런타임에만 감지될 수 있으므로 코드를 주의 깊게 검토하십시오.",
    ),
    "Portuguese": (
        "Este notebook foi convertido automaticamente do script abaixo. Pode conter erros, então use-o como ponto de partida e faça as correções necessárias.",
        "Script fonte",
        "Resultados da verificação de sintaxe estática",
        "Estes são erros de verificações de sintaxe estática. Correções manuais são necessárias para esses erros.",
        "Erros de sintaxe Python",
        "Erros de sintaxe Spark SQL",
        "Nenhum erro de sintaxe foi detectado durante a verificação estática.",
        "No entanto, revise o código cuidadosamente, pois alguns problemas podem ser detectados apenas durante a execução.",
    ),
    "Spanish": (
        "Este notebook se convirtió automáticamente del script a continuación. Puede contener errores, así que úselo como punto de partida y realice las correcciones necesarias.",
        "Script fuente",
        "Resultados de la comprobación de sintaxis estática",
        "Estos son errores de las comprobaciones de sintaxis estáticas. Se requieren correcciones manuales para estos errores.",
        "Errores de sintaxis de Python",
        "Errores de sintaxis de Spark SQL",
        "No se detectaron errores de sintaxis durante la comprobación estática.",
        "Sin embargo, revise cuidadosamente el código, ya que algunos problemas solo pueden detectarse durante la ejecución.",
    ),
}


def messages_table(spark: SparkSession) -> DataFrame:
    """(language, one column per message key)."""
    rows = [(language, *texts) for language, texts in MESSAGES.items()]
    return small_table(spark, rows, [("language", "string"), *((key, "string") for key in KEYS)])
