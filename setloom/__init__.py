"""Set-completion analytics and corpus preparation as declarative Spark plans."""
