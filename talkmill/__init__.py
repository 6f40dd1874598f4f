"""talkmill: data work behind multilingual dialogue translation, on Spark."""
