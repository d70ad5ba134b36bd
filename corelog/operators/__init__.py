"""corelog.operators"""
