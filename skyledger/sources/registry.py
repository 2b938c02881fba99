"""Service registry: dataset, ingestion source and input type per service.

Most services follow a rule (``aws.<service>``, delivered through CloudWatch), so only the
exceptions are listed. A deployment with its own services passes a registry DataFrame with the
same columns instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Datasets that differ from "aws." + service, for logs and for metrics.
LOG_DATASETS = {
    "vpc": "aws.vpcflow",
    "alb": "aws.elb_logs",
    "nlb": "aws.elb_logs",
    "s3": "aws.s3access",
    "storagelens": "aws.s3_storage_lens",
    "apigateway": "aws.apigateway_logs",
    "cloudfront": "aws.cloudfront_logs",
    "lambda": "aws.lambda_logs",
    "networkfirewall": "aws.firewall_logs",
    "securityhub": "aws.securityhub_findings",
    "wafv2": "aws.waf",
    "route53": "aws.route53_public_logs",
    "emr": "aws.emr_logs",
    "ec2": "aws.ec2_logs",
    "ecs": "aws.ecs_metrics",
    "msk": "aws.kafka_metrics",
    "cspm": "cloud_security_posture.findings",
    "kspm": "cloud_security_posture.findings",
    "health": "aws.awshealth",
    "mainframemodernization": "aws.m2",
    "parallelcomputing": "aws.pcs",
    "cloudwatchrum": "aws.cloudwatch_rum",
}
METRIC_DATASETS = {
    "lambda": "aws.lambda",
    "apigateway": "aws.apigateway_metrics",
    "ecs": "aws.ecs_metrics",
    "fargate": "aws.ecs_metrics",
    "msk": "aws.kafka_metrics",
    "emr": "aws.emr_metrics",
    "s3": "aws.s3_daily_storage",
    "cloudwatch": "aws.cloudwatch_metrics",
    "alb": "aws.elb",
    "nlb": "aws.elb",
    "networkfirewall": "aws.firewall",
    "storagelens": "aws.s3_storage_lens",
    "vpc": "aws.vpcflow",
    "route53": "aws.route53_public_logs",
    "iotcore": "aws.iot",
}

# Services that do not arrive through CloudWatch, by ingestion source.
SOURCE_SERVICES = {
    "s3": "cloudtrail alb nlb cloudfront waf wafv2 vpc networkfirewall s3 storagelens",
    "firehose": "firehose",
    "api": (
        "guardduty securityhub inspector config accessanalyzer macie detective trustedadvisor "
        "computeoptimizer budgets billing servicequotas frauddetector xray securityir "
        "auditmanager artifact appfabric securitylake security-chain cspm kspm "
        "iam-privesc-chain data-exfil-chain networkaccessanalyzer incidentmanager cloudwatchrum"
    ),
}
DEFAULT_SOURCE = "cloudwatch"

# Input type per ingestion source.
INPUT_TYPES = {
    "s3": "aws-s3",
    "cloudwatch": "aws-cloudwatch",
    "firehose": "aws-firehose",
    "api": "http_endpoint",
    "otel": "opentelemetry",
    "agent": "logfile",
}

# Services whose log documents carry host fields.
COMPUTE_SERVICES = (
    "ec2 ecs eks fargate lambda apprunner batch elasticbeanstalk lightsail outposts wavelength "
    "workspaces appstream gamelift mainframemodernization parallelcomputing evs simspaceweaver "
    "robomaker"
).split()

# Services that have a metrics mode. Any other service, known or not, has none.
METRIC_SERVICES = (
    "lambda ec2 ecs fargate eks apprunner elasticbeanstalk batch wavelength ecr apigateway alb nlb "
    "cloudfront natgateway transitgateway vpn networkfirewall globalaccelerator directconnect vpc "
    "privatelink networkmanager appmesh clientvpn cloudmap outposts verifiedpermissions dax "
    "chimesdkvoice drs rds aurora dynamodb redshift ebs s3 storagelens elasticache opensearch docdb "
    "neptune keyspaces memorydb qldb timestream efs fsx backup datasync storagegateway kinesis "
    "kinesisanalytics msk firehose sns sqs eventbridge amazonmq waf wafv2 shield kms cognito guardduty "
    "macie inspector config accessanalyzer secretsmanager acm identitycenter detective verifiedaccess "
    "securitylake cloudtrail securityhub glue athena emr sagemaker bedrock bedrockagent lakeformation "
    "databrew appflow rekognition textract comprehend comprehendmedical translate transcribe polly "
    "forecast personalize lex lookoutmetrics qbusiness nova lookoutvision codebuild codepipeline "
    "codedeploy amplify codecommit codeartifact codeguru cloudwatch stepfunctions appsync health "
    "billing cloudformation ssm trustedadvisor controltower organizations servicecatalog "
    "servicequotas computeoptimizer budgets dms resiliencehub ram migrationhub devopsguru iotcore "
    "greengrass iotanalytics iotevents iotsitewise iotdefender workspaces connect gamelift "
    "transferfamily appstream pinpoint lightsail frauddetector locationservice mediaconvert medialive "
    "managedblockchain route53 autoscaling quicksight imagebuilder xray ses lookoutequipment monitron "
    "networkaccessanalyzer incidentmanager cloudshell cloud9 robomaker kinesisvideo panorama freertos "
    "cloudwatchrum"
).split()

REGISTRY_DDL = (
    "service STRING, service_group STRING, logs_dataset STRING, metrics_dataset STRING, "
    "default_source STRING, supports_metrics BOOLEAN"
)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def fallback_dataset(service: Column) -> Column:
    return F.concat(F.lit("aws."), service)


def logs_dataset(service: Column) -> Column:
    return F.coalesce(lookup(LOG_DATASETS, service), fallback_dataset(service))


def metrics_dataset(service: Column) -> Column:
    return F.coalesce(lookup(METRIC_DATASETS, service), logs_dataset(service))


def resolve_dataset(service: Column, event_type: str) -> Column:
    """Metrics map, then logs map, then the naming rule."""
    return metrics_dataset(service) if event_type == "metrics" else logs_dataset(service)


def default_source(service: Column) -> Column:
    owners = {s: src for src, names in SOURCE_SERVICES.items() for s in names.split()}
    return F.coalesce(lookup(owners, service), F.lit(DEFAULT_SOURCE))


def resolve_source(service: Column, override: Column | None = None) -> Column:
    """An override other than ``default`` wins over the service's own source."""
    if override is None:
        return default_source(service)
    chosen = F.when((override != "default") & (override != ""), override)
    return F.coalesce(chosen, default_source(service))


def input_type(source: Column) -> Column:
    """E5."""
    return lookup(INPUT_TYPES, source)


def supports_metrics(service: Column) -> Column:
    return F.coalesce(service.isin(*METRIC_SERVICES), F.lit(False))


def registry(services: DataFrame, group: str | None = None) -> DataFrame:
    """Registry rows for a DataFrame of services (``service`` and optionally a group column)."""
    svc = F.col("service")
    return services.select(
        svc,
        (F.col(group) if group else F.lit(None).cast("string")).alias("service_group"),
        logs_dataset(svc).alias("logs_dataset"),
        metrics_dataset(svc).alias("metrics_dataset"),
        default_source(svc).alias("default_source"),
        supports_metrics(svc).alias("supports_metrics"),
    )


def registry_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REGISTRY_DDL)


def join_registry(docs: DataFrame, reg: DataFrame, key: str = "service") -> DataFrame:
    """Document to registry, unknown services kept with NULLs."""
    return docs.join(reg, key, "left")


def metrics_capable(docs: DataFrame, reg: DataFrame, key: str = "service") -> DataFrame:
    """keep documents of services that have a metrics mode."""
    capable = reg.filter("supports_metrics").select(key).distinct()
    return docs.join(capable, key, "left_semi")
