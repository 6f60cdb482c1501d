"""Jobs with a command line: each module has run(spark, ...), main() and a config file of its name."""
