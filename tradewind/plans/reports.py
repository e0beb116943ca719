"""All reports over the stored gold tables of a finished run, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tradewind.plans import forecast, insights, kpis

Read = Callable[[str], DataFrame]


def from_gold(read: Read) -> dict[str, Callable[[], DataFrame]]:
    """Report name -> function that builds it. ``read`` gives a gold table by its name; only what is called is read."""

    def customers() -> DataFrame:
        return read("customer_analytics")

    def products() -> DataFrame:
        return read("product_analytics")

    def months() -> DataFrame:
        return read("monthly_sales")

    def cohorts() -> DataFrame:
        return read("cohort_by_month")

    def split() -> DataFrame:
        return forecast.with_split(forecast.with_month_number(months()))

    return {
        "age_groups": lambda: insights.value_counts(customers(), "customer_age_group"),
        "value_segments": lambda: insights.value_counts(customers(), "value_segment"),
        "recency_segments": lambda: insights.value_counts(customers(), "recency_segment"),
        "sales_performance": lambda: insights.value_counts(products(), "sales_performance", "product_count"),
        "top_countries": lambda: insights.top_countries(customers()),
        "country_summary": lambda: insights.country_summary(customers()),
        "spending_points": lambda: insights.spending_points(customers()),
        "revenue_by_category": lambda: insights.revenue_by_category(products()),
        "product_points": lambda: insights.product_points(products()),
        "best_sellers": lambda: insights.best_sellers(products()),
        "category_stats": lambda: insights.category_stats(products()),
        "monthly_trend": lambda: insights.monthly_trend(months()),
        "daily_revenue": lambda: insights.daily_revenue(read("daily_sales")),
        "weekday_performance": lambda: insights.weekday_performance(read("daily_sales")),
        "retention_matrix": lambda: insights.retention_matrix(cohorts()),
        "retention_rates": lambda: insights.retention_rates(cohorts()),
        "cohort_sizes": lambda: insights.cohort_sizes_at_start(cohorts()),
        "executive_metrics": lambda: insights.executive_metrics(customers(), products(), months()),
        "top_category": lambda: insights.top_category(read("category_sales")),
        "order_value_histogram": lambda: insights.order_value_histogram(customers()),
        "top_age_group": lambda: insights.top_age_group(customers()),
        "churn_rate": lambda: insights.churn_rate(customers()),
        "top_country": lambda: insights.top_revenue_country(customers()),
        "top_customers": lambda: kpis.top_customers(customers()),
        "top_products": lambda: kpis.top_products(products()),
        "first_months": lambda: kpis.first_months(months()),
        "forecast": lambda: forecast.predict(split()),
        "forecast_error": lambda: forecast.rmse(forecast.predict(split())),
    }
