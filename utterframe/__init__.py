"""utterframe: analytics over speech transcripts, alignments and their text corpora, on Spark."""
