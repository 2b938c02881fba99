"""Detector jobs: the documented catalogue as data.

Dataset, function and split follow the published job list; the fields and conditions are the
ones the documents of each service carry.
"""

from __future__ import annotations

from skyledger.operators.detect import Job

FAIL = (("event.outcome", "eq", "failure"),)
REQUEST = (("processor.event", "eq", "transaction"),)
ERR5 = (("http.response.status_code", "ge", 500),)
ERR4 = (("http.response.status_code", "ge", 400),)


def _eq(field: str, value: str | int) -> tuple:
    return ((field, "eq", value),)


def _in(field: str, *values: str) -> tuple:
    return ((field, "in", values),)


SEVERE = ("HIGH", "CRITICAL")
API_GW = "aws.apigateway"

# Fixed values: (id, dataset, function, field, split, conditions) per group.
CATALOGUE = {
    "security": [
        ("aws-vpcflow-high-bytes-tx", "aws.vpcflow", "high_sum", "network.bytes", "destination.ip"),
        ("aws-vpcflow-rare-dest-port", "aws.vpcflow", "rare", "", "destination.port"),
        ("aws-vpcflow-high-denied-count", "aws.vpcflow", "high_count", "", "source.ip",
         _eq("event.action", "reject")),
        ("aws-guardduty-finding-spike", "aws.guardduty", "high_count", "",
         "aws.guardduty.severity.value"),
        ("aws-guardduty-rare-finding-type", "aws.guardduty", "rare", "", "aws.guardduty.type"),
        ("aws-waf-high-block-rate", "aws.waf", "high_count", "", "source.ip",
         _eq("event.action", "block")),
        ("aws-cloudtrail-rare-user-action", "aws.cloudtrail", "rare", "",
         "event.action user.name"),
    ],
    "security-extended": [
        ("aws-securityhub-critical-finding-spike", "aws.securityhub_findings", "high_count", "", "",
         _in("aws.securityhub_findings.severity.label", *SEVERE)),
        ("aws-macie-finding-spike", "aws.macie", "high_count", "", "aws.macie.s3_bucket.name",
         FAIL),
        ("aws-inspector-critical-vuln-spike", "aws.inspector", "high_mean",
         "aws.inspector2.severity_score", "aws.inspector2.resource_id",
         _eq("aws.inspector2.severity", "CRITICAL")),
        ("aws-config-noncompliance-spike", "aws.config", "high_count", "", "",
         _eq("aws.config.compliance_type", "NON_COMPLIANT")),
        ("aws-kms-unusual-operation", "aws.kms", "rare", "",
         "aws.kms.operation cloud.account.id"),
        ("aws-securitylake-ocsf-finding-spike", "aws.securitylake", "high_count", "",
         "aws.securitylake.class_uid", _in("aws.securitylake.severity", "High", "Critical")),
        ("aws-securitylake-rare-ocsf-class", "aws.securitylake", "rare", "",
         "aws.securitylake.class_uid"),
    ],
    "compute": [
        ("aws-lambda-error-spike", "aws.lambda_logs", "high_count", "", "aws.lambda.function.name",
         FAIL),
        ("aws-lambda-duration-anomaly", "aws.lambda_logs", "high_mean",
         "aws.lambda.metrics.Duration.avg", "aws.lambda.function.name"),
        ("aws-lambda-throttle-spike", "aws.lambda_logs", "high_mean",
         "aws.lambda.metrics.Throttles.sum", "aws.lambda.function.name"),
        ("aws-ec2-cpu-anomaly", "aws.ec2_logs", "high_mean", "aws.ec2.metrics.CPUUtilization.avg",
         "aws.dimensions.InstanceId"),
        ("aws-ec2-network-spike", "aws.ec2_logs", "high_sum", "aws.ec2.metrics.NetworkOut.sum",
         "aws.dimensions.InstanceId"),
        ("aws-eks-pod-failure-spike", "aws.eks", "high_count", "", "kubernetes.namespace", FAIL),
        ("aws-eks-rare-image", "aws.eks", "rare", "", "container.image.name"),
    ],
    "compute-extended": [
        ("aws-ecs-memory-pressure", "aws.ecs_metrics", "high_mean",
         "aws.ecs.metrics.MemoryUtilization.avg", "aws.dimensions.ClusterName"),
        ("aws-ecs-task-failure-spike", "aws.ecs_metrics", "high_count", "",
         "aws.dimensions.ClusterName", FAIL),
        ("aws-autoscaling-rapid-scaling", "aws.autoscaling", "high_mean",
         "aws.autoscaling.desired_capacity", "aws.autoscaling.group_name"),
        ("aws-beanstalk-5xx-spike", "aws.elasticbeanstalk", "high_mean",
         "aws.elasticbeanstalk.metrics.ApplicationRequests5xx.sum",
         "aws.elasticbeanstalk.environment_name"),
        ("aws-beanstalk-latency-p99-anomaly", "aws.elasticbeanstalk", "high_mean",
         "aws.elasticbeanstalk.metrics.ApplicationLatencyP99.avg",
         "aws.elasticbeanstalk.environment_name"),
    ],
    "networking": [
        ("aws-alb-5xx-spike", "aws.elb_logs", "high_count", "", "aws.dimensions.TargetGroup", ERR5),
        ("aws-alb-response-time-anomaly", "aws.elb_logs", "high_mean", "event.duration", ""),
        ("aws-alb-rare-user-agent", "aws.elb_logs", "rare", "", "user_agent.original"),
        ("aws-apigateway-latency-anomaly", f"{API_GW}_logs", "high_mean",
         f"{API_GW}.metrics.Latency.avg", f"{API_GW}.stage"),
        ("aws-apigateway-error-spike", f"{API_GW}_logs", "high_count", "", f"{API_GW}.stage", ERR4),
    ],
    "networking-extended": [
        ("aws-cloudfront-error-rate-spike", "aws.cloudfront_logs", "high_count", "", "", ERR5),
        ("aws-cloudfront-cache-miss-spike", "aws.cloudfront_logs", "high_count", "", "",
         _eq("aws.cloudfront.edge_result_type", "Miss")),
        ("aws-route53-nxdomain-spike", "aws.route53_public_logs", "high_count", "", "",
         _eq("dns.response_code", "NXDOMAIN")),
        ("aws-networkfirewall-drop-spike", "aws.firewall_logs", "high_count", "", "",
         _eq("event.action", "drop")),
    ],
    "databases": [
        ("aws-rds-latency-anomaly", "aws.rds", "high_mean", "event.duration",
         "aws.rds.db_instance.identifier"),
        ("aws-rds-connection-spike", "aws.rds", "high_count", "", "aws.rds.db_instance.identifier",
         _eq("event.action", "connection")),
        ("aws-aurora-replica-lag", "aws.aurora", "high_mean", "aws.aurora.replica_lag_seconds",
         "aws.aurora.cluster_id"),
        ("aws-aurora-serverless-capacity", "aws.aurora", "high_max",
         "aws.aurora.metrics.ServerlessDatabaseCapacity.avg", "aws.aurora.cluster_id"),
        ("aws-elasticache-hit-rate-drop", "aws.elasticache", "low_mean",
         "aws.elasticache.metrics.CacheHitRate.avg", "aws.dimensions.CacheNodeId"),
        ("aws-elasticache-latency-spike", "aws.elasticache", "high_mean", "event.duration",
         "aws.dimensions.CacheNodeId"),
    ],
    "databases-extended": [
        ("aws-dynamodb-throttle-spike", "aws.dynamodb", "high_mean",
         "aws.dynamodb.metrics.ReadThrottleEvents.sum", "aws.dynamodb.table_name"),
        ("aws-dynamodb-latency-anomaly", "aws.dynamodb", "high_mean",
         "aws.dynamodb.metrics.SuccessfulRequestLatency.avg", "aws.dynamodb.table_name"),
        ("aws-redshift-query-duration-anomaly", "aws.redshift", "high_mean",
         "aws.redshift.duration_seconds", "aws.redshift.cluster_id"),
        ("aws-opensearch-jvm-pressure", "aws.opensearch", "high_mean",
         "aws.opensearch.metrics.JVMMemoryPressure.avg", "aws.opensearch.domain_name"),
        ("aws-opensearch-write-rejections", "aws.opensearch", "high_mean",
         "aws.opensearch.metrics.ThreadpoolWriteRejected.sum", "aws.opensearch.domain_name"),
    ],
    "streaming": [
        ("aws-kinesis-iterator-age-anomaly", "aws.kinesis", "high_mean",
         "aws.kinesis.iterator_age_ms", "aws.dimensions.StreamName"),
        ("aws-kinesis-throughput-anomaly", "aws.kinesis", "high_sum",
         "aws.kinesis.incoming_bytes", "aws.dimensions.StreamName"),
        ("aws-sqs-message-age-anomaly", "aws.sqs", "high_mean",
         "aws.sqs.oldest_message_age.sec", "aws.sqs.queue.name"),
        ("aws-sqs-not-visible-spike", "aws.sqs", "high_count", "", "aws.sqs.queue.name",
         (("aws.sqs.messages.not_visible", "ge", 1),)),
        ("aws-kinesisanalytics-kpu-spike", "aws.kinesisanalytics", "high_mean",
         "aws.kinesisanalytics.metrics.kpu_utilization_pct",
         "aws.kinesisanalytics.application_name"),
        ("aws-kinesisanalytics-checkpoint-anomaly", "aws.kinesisanalytics", "high_mean",
         "aws.kinesisanalytics.metrics.checkpoint_duration_ms",
         "aws.kinesisanalytics.application_name"),
    ],
    "messaging": [
        ("aws-sns-delivery-failure-spike", "aws.sns", "high_mean",
         "aws.sns.metrics.NumberOfNotificationsFailed.sum", ""),
        ("aws-msk-consumer-lag-anomaly", "aws.kafka_metrics", "high_mean", "aws.msk.lag",
         "aws.msk.cluster_name"),
        ("aws-msk-under-replicated-partitions", "aws.kafka_metrics", "high_mean",
         "aws.msk.under_replicated_partitions", "aws.msk.cluster_name"),
        ("aws-eventbridge-failed-invocations", "aws.eventbridge", "high_mean",
         "aws.eventbridge.metrics.FailedInvocations.sum", "aws.eventbridge.rule"),
        ("aws-stepfunctions-execution-failure-spike", "aws.stepfunctions", "high_mean",
         "aws.stepfunctions.metrics.ExecutionsFailed.sum",
         "aws.stepfunctions.state_machine_name"),
    ],
    "analytics": [
        ("aws-glue-job-duration-anomaly", "aws.glue", "high_mean", "event.duration",
         "aws.glue.job.name"),
        ("aws-glue-failure-spike", "aws.glue", "high_count", "", "aws.glue.job.name", FAIL),
        ("aws-athena-data-scanned-spike", "aws.athena", "high_sum",
         "aws.athena.data_scanned_bytes", "aws.athena.workgroup"),
        ("aws-athena-query-duration-anomaly", "aws.athena", "high_mean", "event.duration",
         "aws.athena.workgroup"),
        ("aws-emr-task-failure-spike", "aws.emr_logs", "high_mean",
         "aws.emr.metrics.numFailedTasks", "aws.emr.cluster_name"),
    ],
    "aiml": [
        ("aws-bedrock-token-usage-spike", "aws.bedrock", "high_sum",
         "aws.bedrock.total_token_count", "aws.bedrock.model_id"),
        ("aws-bedrock-latency-anomaly", "aws.bedrock", "high_mean",
         "aws.bedrock.invocation_latency_ms", "aws.bedrock.model_id"),
        ("aws-bedrock-error-spike", "aws.bedrock", "high_count", "", "aws.bedrock.model_id", FAIL),
        ("aws-bedrock-rare-model", "aws.bedrock", "rare", "", "aws.bedrock.model_id"),
    ],
    "storage": [
        ("aws-s3-bandwidth-anomaly", "aws.s3access", "high_sum", "aws.s3access.bytes_sent",
         "aws.s3access.bucket"),
        ("aws-s3-error-spike", "aws.s3access", "high_count", "", "aws.s3access.bucket", ERR4),
        ("aws-s3-rare-operation", "aws.s3access", "rare", "", "aws.s3access.operation"),
        ("aws-s3-rare-requester", "aws.s3access", "rare", "", "aws.s3access.requester"),
    ],
    "management": [
        ("aws-cloudwatch-alarm-storm", "aws.cloudwatch", "high_count", "", "", FAIL),
        ("aws-cloudformation-rollback-spike", "aws.cloudformation", "high_count", "", "", FAIL),
        ("aws-billing-cost-anomaly", "aws.billing", "high_mean",
         "aws.billing.estimated_charges", ""),
        ("aws-ssm-rare-command", "aws.ssm", "rare", "", "aws.ssm.action aws.ssm.instance_id"),
    ],
    "apm-traces": [
        ("apm-transaction-duration-anomaly", "apm", "high_mean", "transaction.duration.us",
         "service.name"),
        ("apm-error-rate-spike", "apm", "high_count", "", "service.name", FAIL, REQUEST),
        ("apm-service-throughput-drop", "apm", "low_count", "", "service.name", REQUEST),
        ("apm-slow-span-by-type", "apm", "high_mean", "span.duration.us", "span.type"),
        ("apm-lambda-cold-start-spike", "apm", "high_count", "", "",
         (("faas.coldstart", "true", True),)),
        ("apm-emr-stage-duration-anomaly", "apm", "high_mean", "span.duration.us", "",
         _eq("span.subtype", "spark")),
    ],
    "serverless": [
        ("aws-apigateway-5xx-error-spike", f"{API_GW}_logs", "high_count", "", f"{API_GW}.stage",
         ERR5),
        ("aws-apigateway-throttle-spike", f"{API_GW}_logs", "high_count", "", "",
         _eq("http.response.status_code", 429)),
        ("aws-apigateway-latency-anomaly", f"{API_GW}_logs", "high_mean",
         f"{API_GW}.integration_latency", f"{API_GW}.stage"),
        ("aws-lambda-cold-start-spike", "aws.lambda_logs", "high_count", "",
         "aws.lambda.function.name", (("aws.lambda.init_duration_ms", "ge", 0.001),)),
    ],
    "devtools": [
        ("aws-codebuild-failure-spike", "aws.codebuild", "high_count", "",
         "aws.codebuild.project_name", FAIL),
        ("aws-codebuild-duration-anomaly", "aws.codebuild", "high_mean",
         "aws.codebuild.duration_seconds", "aws.codebuild.project_name"),
        ("aws-codepipeline-failure-spike", "aws.codepipeline", "high_count", "",
         "aws.codepipeline.pipeline_name", FAIL),
        ("aws-xray-error-rate-spike", "aws.xray", "high_count", "", "service.name", FAIL),
        ("aws-xray-latency-anomaly", "aws.xray", "high_mean", "event.duration", "service.name"),
    ],
    "iot": [
        ("aws-iotcore-connection-failure-spike", "aws.iotcore", "high_count", "", "",
         (("aws.iotcore.action", "eq", "Connect"), ("event.outcome", "eq", "failure"))),
        ("aws-iotcore-message-volume-anomaly", "aws.iotcore", "count", "", "",
         _eq("aws.iotcore.action", "Publish")),
        ("aws-iotcore-rule-error-spike", "aws.iotcore", "high_count", "", "aws.iotcore.rule_name",
         FAIL),
        ("aws-iotcore-rare-client", "aws.iotcore", "rare", "", "aws.iotcore.client_id"),
    ],
    "media": [
        ("aws-mediaconvert-failure-spike", "aws.mediaconvert", "high_count", "",
         "aws.mediaconvert.queue_arn", FAIL),
        ("aws-connect-contact-abandonment-spike", "aws.connect", "high_count", "",
         "aws.connect.queue_name", _eq("aws.connect.disconnect_reason", "ABANDONED")),
        ("aws-connect-handle-time-anomaly", "aws.connect", "high_mean",
         "aws.connect.handle_time_seconds", "aws.connect.queue_name"),
        ("aws-workspaces-session-failure-spike", "aws.workspaces", "high_count", "", "", FAIL),
    ],
    "siem": [
        ("aws-cloudtrail-rare-source-ip", "aws.cloudtrail", "rare", "", "source.ip"),
        ("aws-cloudtrail-root-activity", "aws.cloudtrail", "high_count", "", "",
         _eq("aws.cloudtrail.user_identity.type", "Root")),
        ("aws-cloudtrail-iam-creation-spike", "aws.cloudtrail", "high_count", "", "",
         _in("event.action", "CreateUser", "CreateRole", "CreatePolicy", "AttachUserPolicy",
             "AttachRolePolicy", "CreateAccessKey")),
        ("aws-route53-dns-exfiltration", "aws.route53_public_logs", "high_count", "",
         "dns.question.name"),
    ],
}


def _job(group: str, row: tuple) -> Job:
    name, dataset, function, field, split, *conditions = row
    # Billing costs are explained by account and region; others add their split fields.
    influencers = ("cloud.region", "cloud.account.id", *split.split())
    return Job(
        group, name, dataset, function, field, tuple(split.split()),
        tuple(c for part in conditions for c in part), tuple(dict.fromkeys(influencers)),
        "traces" if dataset in ("apm", "aws.xray") else "logs",
    )


def jobs_of(*groups: str) -> list[Job]:
    """Jobs of the named groups; all of them when no group is named."""
    return [_job(g, row) for g, rows in CATALOGUE.items() if not groups or g in groups for row in rows]


def installable(jobs: list[Job]) -> list[Job]:
    """An id that is already taken is skipped, as on installation into one cluster."""
    seen: set[str] = set()
    out = []
    for job in jobs:
        if job.id not in seen:
            seen.add(job.id)
            out.append(job)
    return out
