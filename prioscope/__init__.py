"""Priority audits of support-ticket queues, expressed as Spark DataFrame plans."""
