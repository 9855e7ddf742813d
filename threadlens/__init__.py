"""threadlens: a Spark-native engine for conversational session transcripts.

sources/    files to lines to events        operators/  DataFrame to DataFrame
functions/  column expressions and parsers  plans/      named queries over the driver tables
streaming/  Structured Streaming forms
"""
